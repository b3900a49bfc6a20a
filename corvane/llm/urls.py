"""URL filter with a weighted vocabulary and host/path rules.

The vocabulary has strict and soft terms, by default a short list in five languages, else those of a stored table of weighted
terms (``vocabulary``). One Aho-Corasick automaton finds all of them in a lower-cased URL in one pass;
a find counts only where no letter or digit touches it. One strict term, or ``soft_limit`` distinct soft terms, block.
Rules (host and path prefix, allow or block) come first: a rule fits its host and all subdomains when the URL's path
starts with the rule's path; of several the longest wins. Everything happens where the rows are read, without a shuffle.

Cases: a null URL or one without ``://`` has an empty host and path, no rule, and is judged by its terms (none for null);
user names and ports stay part of the host; of rules of equal length the first given wins; a URL of any length is scanned
whole; without terms everything that no rule blocks is allowed; repeated rows are judged alike; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import lower_ascii, map_rows

# Default vocabulary: our own choice of usual words of unwanted pages in five languages; pass a table for more.
#: One of these is enough to block.
STRICT = (
    "casino", "kasino", "porn", "porno", "pornographie", "pornografia", "xxx", "viagra", "cialis", "escort", "escorts",
    "warez", "malware", "phishing", "keygen", "sexcam", "sexshop", "blackjack", "roulette", "sportwetten", "apuestas",
)
#: Several distinct ones are needed.
SOFT = (
    "ads", "track", "tracker", "click", "bets", "bet", "betting", "pills", "cheap", "free", "win", "bonus", "poker", "slots",
    "loan", "loans", "promo", "deal", "deals", "hot", "adult", "crack", "download", "torrent", "replica", "diet", "crypto",
    "gambling", "lottery", "jackpot", "dating", "sexy", "pharmacy", "kostenlos", "gratis", "gewinn", "wetten", "lotto",
    "kredit", "rabatt", "angebot", "gratuit", "gagner", "rencontre", "soldes", "oferta", "descuento", "ganar", "loteria",
    "prestamo", "farmacia", "sconto", "scommesse", "prestito",
)
SOFT_LIMIT = 2
MOST_TERMS = 1_000_000  # of a vocabulary table; the automaton is made in every worker


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def vocabulary(table: DataFrame, term: str = "term", weight: str = "weight", limit: int = SOFT_LIMIT) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a stored vocabulary: a weight of ``limit`` or more is enough alone, a smaller one above 0 is
    soft. Terms are lower-cased; of a term's weights the greatest counts; null and empty terms are left out; a table of
    more than ``MOST_TERMS`` terms is an error."""
    rows = table.where(f"{term} <> '' AND {weight} > 0").groupBy(lower_ascii(F.col(term)).alias("t")).agg(F.max(weight).alias("w"))
    found = sorted(tuple(r) for r in rows.limit(MOST_TERMS + 1).collect())
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return tuple(t for t, w in found if w >= limit), tuple(t for t, w in found if w < limit)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Index of the longest rule that fits, or null."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    fits = [((host == rules[i].host) | host.endswith("." + rules[i].host)) & path.startswith(rules[i].path) for i in order]
    return F.coalesce(*[F.when(fit, F.lit(i)) for i, fit in zip(order, fits)], F.lit(None).cast("int"))


def count_terms(
    df: DataFrame, url: Column, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, keep: Column | None = None
) -> DataFrame:
    """``row``, ``strict_terms`` and ``soft_terms``: the distinct terms found in each URL, sorted."""
    kinds = {t: "soft" for t in soft} | {t: "strict" for t in strict}

    def run(batch, state=[]):  # noqa: B006  one automaton a worker
        import ahocorasick

        if not state:
            automaton = ahocorasick.Automaton()
            for term in kinds:
                automaton.add_word(term, term)
            automaton.make_automaton()
            state.append(automaton if kinds else None)
        out = {"strict_terms": [], "soft_terms": []}
        for url in batch["url"]:
            found = {"strict": set(), "soft": set()}
            for end, term in state[0].iter(url) if url and kinds else ():
                before, after = url[: end + 1 - len(term)][-1:], url[end + 1 : end + 2]
                if not (before.isalnum() and before.isascii() or after.isalnum() and after.isascii()):
                    found[kinds[term]].add(term)
            out["strict_terms"].append(sorted(found["strict"]))
            out["soft_terms"].append(sorted(found["soft"]))
        return out

    types = "strict_terms array<string>, soft_terms array<string>"
    return map_rows(df, run, {"url": lower_ascii(url)}, types, keep)


def judge(
    df: DataFrame,
    url: Column,
    rules: Sequence[Rule] = (),
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = SOFT_LIMIT,
    keep: Column | None = None,
) -> DataFrame:
    """``row``, ``host``, ``path``, ``rule`` (its name or null), ``verdict`` and the terms found."""
    host, path = host_and_path(url)
    keep = F.struct("*") if keep is None else keep
    parts = df.select(keep.alias("row"), url.alias("url"), host.alias("host"), path.alias("path"))
    found = count_terms(parts, F.col("url"), strict, soft, F.struct("row", "host", "path"))
    at = rule_for(F.col("row.host"), F.col("row.path"), rules) if rules else F.lit(None).cast("int")
    names = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array(F.lit(""))
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array(F.lit(""))
    blocked = (F.size("strict_terms") > 0) | (F.size("soft_terms") >= soft_limit)
    return found.withColumn("at", at).select(
        F.col("row.row").alias("row"),
        F.col("row.host").alias("host"),
        F.col("row.path").alias("path"),
        F.get(names, F.col("at")).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("at")), F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        "strict_terms",
        "soft_terms",
    )
