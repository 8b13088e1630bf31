"""Rules over logs of requests: form checks, sessions, tokens, sizes and messages. The first rule that fails wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits and messages of the service.
LEAST_PASSWORD = 8
SESSION_SECONDS = 30 * 86_400
CLOCK_SLACK = 60
TOKEN_ALGORITHM = "RS256"
MOST_BODY_BYTES = 1 << 20
FORM_ERRORS = ["All fields are required", "Passwords do not match", "Password must be at least 8 characters", "You must agree to the terms and conditions"]
SIGN_UP_ERRORS = {"EMAIL_EXISTS": "Email already exists", "WEAK_PASSWORD": "Password must be at least 8 characters", "INVALID_EMAIL": "Malformed email address"}
SIGN_UP_DEFAULT = "Failed to create account"
SIGN_IN_DEFAULT = "Invalid email or password"
SIGN_IN_ERRORS = {
    "USER_DISABLED": "This account has been disabled.", "TOO_MANY_ATTEMPTS_TRY_LATER": "Too many failed attempts. Please try again later.",
    "CONFIGURATION_NOT_FOUND": "Authentication is not configured. Please contact the administrator.",
}
RESET_SILENT = ["EMAIL_NOT_FOUND", "INVALID_EMAIL", "MISSING_EMAIL"]  # answered as if all were well
RESET_ERRORS = {"TOO_MANY_ATTEMPTS_TRY_LATER": "Too many requests. Please try again later."}
RESET_DEFAULT = "The reset email could not be sent. Please try again."


def empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def form_error(name: Column, email: Column, password: Column, again: Column, terms: Column) -> Column:
    """What a sign-up form is refused for, or null."""
    missing = empty(name) | empty(email) | empty(password) | empty(again)
    return F.when(missing, FORM_ERRORS[0]).when(password != again, FORM_ERRORS[1]).when(F.length(password) < LEAST_PASSWORD, FORM_ERRORS[2]).when(~F.coalesce(terms, F.lit(False)), FORM_ERRORS[3])


def session_valid(signed: Column, issued: Column, now: Column) -> Column:
    """A good signature, and an issue time that isn't over thirty days ago (the last second counts)."""
    return F.coalesce(signed, F.lit(False)) & F.coalesce(now - issued <= SESSION_SECONDS, F.lit(False))


def claims_valid(claims: Column, project: str, issuer: str, keys: list[str], now: Column) -> Column:
    """Header and claims (alg, kid, aud, iss, sub, exp, iat, auth_time) of a verified token, with disabled and valid_since of its account; keys are the known key ids."""
    headed = (claims["alg"] == TOKEN_ALGORITHM) & claims["kid"].isin(keys)
    fresh = (claims["exp"] > now) & (claims["iat"] <= now + CLOCK_SLACK)
    named = (claims["aud"] == project) & (claims["iss"] == issuer) & ~empty(claims["sub"])
    revoked = (F.coalesce(claims["valid_since"], F.lit(0)) > 0) & (F.coalesce(claims["auth_time"], F.lit(0)) > 0) & (claims["auth_time"] < claims["valid_since"])
    return F.coalesce(headed & named & fresh, F.lit(False)) & ~F.coalesce(claims["disabled"], F.lit(False)) & ~F.coalesce(revoked, F.lit(False))


def terms_outdated(version: Column, current: str) -> Column:
    return F.coalesce(version, F.lit(current)) != current


def too_large(declared: Column) -> Column:
    return F.coalesce(declared.try_cast("bigint") > MOST_BODY_BYTES, F.lit(False))


def message(code: Column, messages: dict[str, str], default: str) -> Column:
    """The message of a code; the default for codes that aren't shown."""
    pairs = F.create_map(*(F.lit(x) for kv in messages.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, F.coalesce(code, F.lit(""))), F.lit(default))


def reset_message(code: Column) -> Column:
    """What is said of a failed password reset; null where it must look like a success, so as not to tell which addresses exist."""
    return F.when(~F.coalesce(code, F.lit("")).isin(RESET_SILENT), message(code, RESET_ERRORS, RESET_DEFAULT))


def shown_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd MMM yyyy, HH:mm"), F.lit(""))


def bytes_served(log: DataFrame) -> DataFrame:
    """(path, requests, bytes) of the answered requests of a log (path, status, bytes)."""
    return log.where(F.col("status") == 200).groupBy("path").agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"))


def without(items: Column, gone: Column) -> Column:
    """items less gone, repeats and order kept."""
    return F.filter(items, lambda x: ~F.array_contains(gone, x))


def producer(path: Column, rules: list[tuple[str, str]], default: str = "in git") -> Column:
    """What the first rule (pattern, producer) that matches a path says."""
    return F.coalesce(*(F.when(path.rlike(p), who) for p, who in rules), F.lit(default))


def bare_aliases(names: DataFrame, suffix: str = ".tfm") -> DataFrame:
    """(name, alias) of names with a suffix whose bare form isn't there yet."""
    made = names.where(F.endswith("name", F.lit(suffix))).select("name", F.expr(f"left(name, length(name) - {len(suffix)})").alias("alias")).distinct()
    return made.join(names.select(F.col("name").alias("alias")), "alias", "left_anti")
