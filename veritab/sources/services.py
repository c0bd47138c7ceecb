"""What outside services answered, read as tables: statuses become one vocabulary, weak answers are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The services' words for delivery.
DELIVERY = {
    "deliverable": ["valid", "deliverable"],
    "undeliverable": ["invalid", "spamtrap", "do_not_mail", "disposable", "undeliverable"],
    "risky": ["catch-all", "abuse", "accept_all", "webmail", "risky"],
}
#: Shapes of keys, by the kind of service.
KEY_SHAPES = {"hex32": r"^[0-9a-f]{32}$", "hex40": r"^[0-9a-f]{40}$", "prefixed": r"^[a-z]{2,8}[-_][A-Za-z0-9_-]{16,}$", "plain": r"^[A-Za-z0-9_-]{20,}$"}


def delivery(answer: Column) -> Column:
    """deliverable, undeliverable, risky or unknown."""
    low = F.lower(F.trim(answer))
    return F.coalesce(*[F.when(low.isin(words), kind) for kind, words in DELIVERY.items()], F.lit("unknown"))


def catch_all(answer: Column) -> Column:
    return F.coalesce(F.lower(F.trim(answer)).isin("catch-all", "accept_all"), F.lit(False))


def outcome(status: Column) -> Column:
    """What an HTTP status means for the next call."""
    return (
        F.when(status.between(200, 299), "ok").when(status == 429, "rate_limited").when(status.isin(401, 403), "not_configured").when(status == 402, "quota_exhausted")
        .when(status >= 500, "retry").when(status >= 400, "failed").otherwise("retry")
    )


def key_shape(key: Column) -> Column:
    """The first shape that a key has, or null."""
    return F.coalesce(*[F.when(key.rlike(p), name) for name, p in KEY_SHAPES.items()])


def accepted_contacts(answers: DataFrame, least_score: int = 70) -> DataFrame:
    """company_id, address, person of contact answers (company_id, person, address, service, score, n_sources, status): of a
    service that cites pages those with a citation and the least score, of one that verifies those it calls verified. A person
    needs two names. The citing service comes first; of several answers the one with the higher score."""
    cites = (F.col("service") == "citing") & (F.col("n_sources") > 0) & (F.col("score") >= least_score)
    verifies = (F.col("service") == "verifying") & (F.lower("status") == "verified")
    good = answers.where((cites | verifies) & F.col("address").isNotNull() & (F.size(F.split(F.trim("person"), r"\s+")) >= 2))
    order = F.struct(F.when(F.col("service") == "citing", 1).otherwise(0), F.coalesce("score", F.lit(0)), "address")
    return good.groupBy("company_id").agg(F.max_by(F.struct("address", "person"), order).alias("c")).select("company_id", "c.address", "c.person")
