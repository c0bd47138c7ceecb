"""What a source may prove, by its host."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.text import alternation, host_of, is_institution, labels_of, path_of, strings, suffixes_of
from ..vocab import AGGREGATOR_HOSTS, AUTHORITY_RANK, NO_COMPANY_HOSTS, PRESS_HOSTS, PRESS_MARKERS, REGISTRY_HOSTS, SOCIAL_HOSTS


def reads_like_press(url: Column) -> Column:
    """An outlet by name with an article's path: a year, or a headline of four words or more."""
    own = labels_of(host_of(url))
    n = F.size(own)
    short_second = (n >= 3) & (F.length(F.try_element_at(own, F.lit(-2))) <= 3)
    base = F.coalesce(F.when(short_second, F.try_element_at(own, F.lit(-3))), F.try_element_at(own, F.lit(-2)), F.try_element_at(own, F.lit(1)))
    segments = F.split(F.regexp_replace(path_of(url), "^/+|/+$", ""), "/")
    slug = F.try_element_at(segments, F.lit(-1))
    article = F.exists(segments, lambda s: s.rlike(r"^\d{4}$")) | (F.length(slug) - F.length(F.replace(slug, F.lit("-"), F.lit(""))) >= 3)
    return F.coalesce(base.rlike(alternation(PRESS_MARKERS)) & article, F.lit(False))


def authority(url: Column, company_domain: Column | None = None) -> Column:
    """Standing of a source. The host and all hosts above it are looked up in constant lists, so nothing is joined."""
    host = host_of(url)
    above = suffixes_of(host)
    known = lambda hosts: F.arrays_overlap(above, strings(hosts))
    out = F.when(host == "", "unknown")
    if company_domain is not None:
        own = F.regexp_replace(F.lower(company_domain), r"^www\.", "")
        out = out.when((host == own) | host.endswith(F.concat(F.lit("."), own)) | own.endswith(F.concat(F.lit("."), host)), "company_owned")
    return (
        out.when(known(REGISTRY_HOSTS), "official_registry").when(known(PRESS_HOSTS), "tier1_press").when(known(AGGREGATOR_HOSTS), "aggregator")
        .when(known(SOCIAL_HOSTS), "social_profile").when(reads_like_press(url), "aggregator").otherwise("unknown")
    )


def rank(standing: Column) -> Column:
    out = None
    for name, value in AUTHORITY_RANK.items():
        out = F.when(standing == name, value) if out is None else out.when(standing == name, value)
    return out.otherwise(0)


def is_company_host(url: Column) -> Column:
    """Whether a host may be a company's own: neither listed as never one nor an institution, at most three dots."""
    host = host_of(url)
    listed = F.arrays_overlap(suffixes_of(host), strings(NO_COMPANY_HOSTS))
    return (host != "") & ~listed & ~is_institution(host) & (F.size(F.split(host, r"\.")) <= 4)
