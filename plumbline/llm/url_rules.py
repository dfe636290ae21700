"""URL verdicts from rules that are found by their rarest literal token.

The tokens that every match of a rule's regular expression must contain are read from the expression itself.
Token frequencies over all URLs choose, for each rule, the rarest of its tokens as its index key. The
tokens of a URL fetch the rules with that key, and only those run their expressions. DataFrame functions only.

Defined cases: a URL that is null or without ``://`` has an empty host and path, fits no rule and gets
the default verdict; repeated rows each get their result; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.tables import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_TOKEN = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for what ``pattern`` matches in host and path together (with a ``name``: a site rule) or in
    the URL. Site rules go before pattern rules, longer names first.
    """

    verdict: str
    pattern: str
    name: str | None = None

    def tokens(self) -> list[str]:
        found = mandatory_tokens(self.pattern)
        if not found:
            raise ValueError(f"no literal token to index the rule {self.pattern!r} by")
        return found


# What an expression's parts come to: a character, what is no letter or digit, anything, or what may be left
# out and else ends with what is no letter or digit.
EDGE, ANY, KEEP = object(), object(), object()


def mandatory_tokens(pattern: str) -> list[str]:
    """The tokens that every match contains: letters and digits that the expression spells out, with
    what is no letter or digit, or an end of the text, on both sides of them.

    Alternatives and repetitions count only as edges. Upper case would meet tokens in lower case, so
    tokens are given in lower case, as those of a URL are.
    """
    found, token = set(), ""
    open_left = True  # whether a token that begins here may have begun before
    for part in [*_parts(parser.parse(pattern)), ANY]:
        if isinstance(part, str):
            token += part
            continue
        if part is EDGE and token and not open_left:
            found.add(token.lower())
        open_left = part is ANY or (part is KEEP and (open_left or bool(token)))
        token = ""
    return sorted(found)


def _is_edge(code: int) -> bool:
    return code < 128 and not chr(code).isalnum()


def _parts(tree: Iterable[tuple]) -> Iterator[str | object]:
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            # Letters beyond ASCII are no part of a token.
            yield chr(value) if value < 128 and chr(value).isalnum() else EDGE
        elif name == "AT":
            yield EDGE if str(value) in ("AT_BEGINNING", "AT_BEGINNING_STRING", "AT_END", "AT_END_STRING") else ANY
        elif name == "IN":
            only = all(str(k) == "LITERAL" and _is_edge(v) for k, v in value)
            yield EDGE if only else ANY
        elif name == "SUBPATTERN":
            yield from _parts(value[-1])
        elif name == "BRANCH":
            ways = [list(_parts(way)) for way in value[1]]
            yield EDGE if all(way and way[0] is EDGE for way in ways) else ANY
            yield EDGE if all(way and way[-1] is EDGE for way in ways) else ANY
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, _, inner = value
            way = list(_parts(inner))
            if not least:
                yield KEEP if way and way[-1] is EDGE else ANY
                continue
            yield EDGE if way and way[0] is EDGE else ANY
            yield EDGE if way and way[-1] is EDGE else ANY
        else:
            yield ANY


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and for paths that start with ``path``."""
    quoted = re.sub(r"([^A-Za-z0-9/])", r"\\\1", host + path)
    return Rule(verdict, rf"^(?:[^/]*\.)?{quoted}", host + path)


SITE_RULES = (
    site_rule("allow", "com", "/"),
    site_rule("block", "example.com", "/en/"),
    site_rule("allow", "www.example.com", "/en/"),
    site_rule("block", "net", "/es/"),
    site_rule("block", "net", "/fr/"),
)
PATTERN_RULES = (
    Rule("block", r"[?&]utm_source=(?:feed|rss)(?:[&#]|$)"),
    # An index key must be in every match, so each form of a literal is a rule by itself.
    Rule("block", r"/ads/"),
    Rule("block", r"/adserver/"),
    Rule("block", r"/track/(?:click|open)/"),
    Rule("block", r"/tracking/(?:click|open)/"),
    Rule("block", r"[?&]sessionid=[0-9a-f]+"),
    Rule("allow", r"/docs/[^?#]*\.html(?:[?#]|$)"),
)


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return _ascii_lower(F.coalesce(rest, F.lit("")))


def url_path(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    return F.coalesce(rest, F.lit(""))


def url_tokens(url: Column) -> Column:
    parts = F.split(_ascii_lower(F.coalesce(url, F.lit(""))), NOT_TOKEN)
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def _rule_rows(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rules as rows, one for each of their tokens."""
    rows = [
        F.struct(
            F.lit(i).alias("rule_no"),
            F.lit(r.verdict).alias("rule_verdict"),
            F.lit(r.pattern).alias("pattern"),
            F.lit(r.name).cast("string").alias("name"),
            F.array(*(F.lit(t) for t in r.tokens())).alias("tokens"),
        )
        for i, r in enumerate(rules)
    ]
    each = spark.range(1).select(F.inline(F.array(*rows)))
    return each.select("*", F.explode("tokens").alias("rule_token")).drop("tokens")


def index_rules(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Each rule once, under the token of its own that fewest URLs contain."""
    by_token = _rule_rows(urls.sparkSession, rules)
    seen = urls.select(F.explode(url_tokens(F.col("url"))).alias("rule_token"))
    wanted = by_token.select("rule_token").distinct()
    counts = seen.join(wanted, "rule_token").groupBy("rule_token").agg(F.count("*").alias("n"))
    rarity = F.struct(F.coalesce(F.col("n"), F.lit(0)).alias("n"), "rule_token")
    return (
        by_token.join(counts, "rule_token", "left")
        .groupBy("rule_no", "rule_verdict", "pattern", "name")
        .agg(F.min(rarity)["rule_token"].alias("rule_token"))
    )


def judge_urls(
    pages: DataFrame,
    site_rules: Sequence[Rule] = SITE_RULES,
    pattern_rules: Sequence[Rule] = PATTERN_RULES,
    default: str = "allow",
) -> DataFrame:
    """page_id, url, host, path, rule (the site rule that fits best), pattern (the pattern rule used
    where no site rule fits; the first in order) and verdict, a row for each row of ``pages``.
    """
    urls = pages.select("page_id", "url")
    index = stored(index_rules(urls, [*site_rules, *pattern_rules]), "rules")
    named = F.col("name").isNotNull()
    subject = F.when(named, F.concat("host", "path")).otherwise(F.col("url"))
    fits = F.regexp_like(subject, F.col("pattern"))
    # Site rules before pattern rules, long names before short ones, early rules before late ones.
    best = F.struct(
        named.alias("named"),
        F.length("name").alias("size"),
        (-F.col("rule_no")).alias("order"),
        "name",
        "pattern",
        "rule_verdict",
    )
    # Repeated rows are judged once; the grouping below keeps this partitioning.
    copies = urls.groupBy("page_id", "url").agg(F.count("*").cast("int").alias("copies"))
    probes = copies.select(
        "page_id",
        "url",
        "copies",
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        F.explode_outer(url_tokens(F.col("url"))).alias("token"),
    )
    judged = (
        probes.join(index, F.col("token") == F.col("rule_token"), "left")
        .groupBy("page_id", "url", "host", "path", "copies")
        .agg(F.max(F.when(fits, best)).alias("best"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    )
    return judged.select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("best.name").alias("rule"),
        F.when(~F.col("best.named"), F.col("best.pattern")).alias("pattern"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
