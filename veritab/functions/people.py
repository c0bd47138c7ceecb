"""Persons and their offices."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..vocab import DEMONYM_COUNTRY, DESCRIPTORS, HEADLINE_VERBS, LABEL_WORDS, NAME_STOP_WORDS, ROLE_WORDS
from .companies import once
from .text import collapse
from .tokens import any_of, classes, part, places, tokens

#: Particles inside names.
PARTICLES = "van von de del della der den di da dos das du la le el al bin binti ibn ter op".split()
#: The offices that count, and offices as national imprints name them.
OFFICES = ["co-founder", "cofounder", "co founder", "founder", "ceo", "cto", "coo", "md", "chief executive officer", "managing director"]
SECOND_ONLY = ["cto", "coo", "md"]  # count beside another office only
IMPRINT_OFFICES = [
    "geschäftsführer", "geschäftsführerin", "geschaeftsfuehrer", "geschaeftsfuehrerin", "gérant", "gérante", "gerant", "gerante", "bestuurder",
    "amministratore unico", "amministratore delegato", "administrador", "administradora", "prezes zarządu", "prezes zarzadu",
]
HONORIFICS = "dr prof mr mrs ms ing mag".split()
LINKS = "is serves as the our".split()
#: Joins the words of an office of several words into one token.
_JOINT = "-"
_one_token = lambda office: office.replace(" ", _JOINT)

#: Classes of tokens: offices (O, second ones Q, imprint ones M), and (a), particles (p), capitalised words (C), initials (I).
_RULES = [
    ("N", lambda t: t == "\n"),
    ("Q", lambda t: F.lower(t).isin(SECOND_ONLY)),
    ("O", lambda t: F.lower(t).isin([_one_token(o) for o in OFFICES])),
    ("M", lambda t: F.lower(t).isin([_one_token(o) for o in IMPRINT_OFFICES])),
    ("a", lambda t: t.isin("and", "&")),
    ("s", lambda t: t.isin(",", "|", "-", "–", "—")),
    (":", lambda t: t == ":"),
    (".", lambda t: t == "."),
    ("p", lambda t: t.isin(PARTICLES)),
    ("h", lambda t: F.lower(t).isin(HONORIFICS)),
    ("v", lambda t: t.isin(LINKS)),
    ("o", lambda t: t == "of"),
    ("f", lambda t: F.lower(t) == "founded"),
    ("b", lambda t: t == "by"),
    ("i", lambda t: t == "in"),
    ("Y", lambda t: t.rlike(r"^\d{4}$")),
    ("I", lambda t: t.rlike(r"^\p{Lu}$")),
    ("C", lambda t: t.rlike(r"^\p{Lu}[\p{L}'’.-]+$")),
]
_NAME, _OFFICE = r"C(?:p?(?:C|I\.?)){1,3}", r"O(?:a[OQ])?"
#: Statements: their parts, which part is the name and which the office (None: the office that is given).
STATEMENTS = [
    ([_NAME, r"s|v{1,3}", _OFFICE], 0, 2, None),
    ([_NAME, r"N", _OFFICE], 0, 2, None),
    ([_OFFICE, r"s|:|v|o[xC]|", _NAME], 2, 0, None),
    ([r"f(?:iY)?b", _NAME], 1, None, "Founder"),
    ([r"M[:s]?(?:h\.?)*", _NAME], 1, None, "Managing Director"),
]


def words_of(name: Column) -> Column:
    return F.split(F.lower(collapse(F.coalesce(name, F.lit("")))), " ")


def is_no_person(name: Column) -> Column:
    """A job or a form label: any word of a job, or nothing but words of labels."""
    plain = F.filter(F.flatten(F.transform(words_of(name), lambda w: F.split(w, r"[^\p{L}]+"))), lambda w: w != "")
    return once(plain, lambda ws: F.exists(ws, lambda w: w.isin(ROLE_WORDS)) | F.forall(ws, lambda w: w.isin(LABEL_WORDS)))


def is_plausible_name(name: Column) -> Column:
    return once(words_of(name), lambda own: F.size(own).between(2, 4) & ~F.exists(own, lambda w: w.isin(NAME_STOP_WORDS)) & ~is_no_person(name) & ~F.coalesce(F.try_element_at(own, F.lit(-1)).isin(PARTICLES), F.lit(False)))


def _statement(i: int, words: Column):
    """What a place of statement i says."""
    _, name, title, given = STATEMENTS[i]

    def read(ts: Column) -> Column:
        out = F.regexp_replace(F.array_join(ts, " "), r" \.", ".")
        for office in OFFICES[OFFICES.index("ceo") :]:  # as several words again
            out = F.regexp_replace(out, f"(?i){_one_token(office)}", office.title()) if " " in office else out
        return collapse(out)

    def one(place: Column) -> Column:
        title_said = F.lit(given) if title is None else read(part(words, place, title))
        return F.struct(F.lit(i).alias("pattern"), read(part(words, place, name)).alias("name"), title_said.alias("title"))

    return one


def people(text: Column) -> Column:
    """array<struct<pattern, name, title>> of the persons whose office a text states, by kind of statement and then in order."""
    none = F.array().cast("array<struct<pattern:int,name:string,title:string>>")

    def stated(words: Column) -> Column:
        # read by every statement, and at each of its places
        return once(classes(words, _RULES), lambda letters: _plausible(F.concat(*[F.transform(places(letters, grammar, "CIp" if grammar[0] == _NAME else "a"), _statement(i, words)) for i, (grammar, *_) in enumerate(STATEMENTS)])))

    said = lambda body: F.when(body.rlike(rf"(?i){any_of([*map(_one_token, OFFICES), *map(_one_token, IMPRINT_OFFICES), 'founded'])}"), once(tokens(body), stated)).otherwise(none)
    return once(_joined(F.coalesce(text, F.lit(""))), said)


def _joined(body: Column) -> Column:
    """A text with each office of several words as one token."""
    several = [o for o in [*OFFICES, *IMPRINT_OFFICES] if " " in o]
    joined = body
    for office in several:
        joined = F.regexp_replace(joined, rf"(?i)\b{any_of([office])}\b", _one_token(office).title())
    return F.when(body.rlike(rf"(?i)\b{any_of(several)}\b"), joined).otherwise(body)


def _plausible(found: Column) -> Column:
    return F.filter(found, lambda p: is_plausible_name(p["name"]))


def title_score(title: Column) -> Column:
    """5 for a founder, 4 for a chief executive, 3 for a managing director, 2 more for a founder who is CEO."""
    t = F.lower(F.coalesce(title, F.lit("")))
    ceo, founder = t.rlike(r"ceo|chief executive"), F.contains(t, F.lit("founder"))
    best = F.greatest(F.when(founder, 5).otherwise(0), F.when(ceo, 4).otherwise(0), F.when(t.rlike("managing director|md"), 3).otherwise(0))
    return best + F.when(F.contains(t, F.lit("ceo")) & founder, 2).otherwise(0)


def is_founder_or_ceo(title: Column) -> Column:
    return F.coalesce(title.rlike(r"(?i)founder|\bceo\b|chief executive|managing director"), F.lit(False))


def company_from_headline(title: Column) -> Column:
    """The company of a funding headline: up to five name words straight before the first verb of funding, or null."""
    head = F.split(F.coalesce(title, F.lit("")), " - ")[0]
    before = F.regexp_extract(head, rf"(?i)^(.*?)\b(?:{HEADLINE_VERBS})\b", 1)
    own = F.filter(F.split(F.trim(F.regexp_replace(before, "^.*:", "")), r"\s+"), lambda t: t != "")

    def names(t: Column) -> Column:
        bare = F.regexp_replace(t, "[,:;]", "")
        return bare.rlike(r"^[A-Za-z0-9][\w&.'’\-]*$") & bare.rlike("[A-Z]") & ~F.lower(bare).isin([*DESCRIPTORS, *DEMONYM_COUNTRY]) & ~bare.rlike(r"['’]s$|(?i)-based$")

    # the last words that all look like parts of a name
    taken = F.aggregate(F.reverse(own), F.struct(F.lit("").alias("name"), F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, t: F.when(
        a["on"] & names(t) & (a["n"] < 5),
        F.struct(F.trim(F.concat(F.regexp_replace(t, "[,:;]", ""), F.lit(" "), a["name"])).alias("name"), (a["n"] + 1).alias("n"), F.lit(True).alias("on")),
    ).otherwise(F.struct(a["name"].alias("name"), a["n"].alias("n"), F.lit(False).alias("on"))))
    return F.nullif(taken["name"], F.lit(""))
