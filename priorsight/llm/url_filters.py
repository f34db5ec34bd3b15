"""URL filters: pattern rules found by their rarest literal token.

Every rule has a pattern over ``host + path``.  The words of the pattern that a
matching URL must hold as whole words are its tokens; the one that fewest URLs
hold becomes its key in the index.  A URL's own tokens fetch the rules that may
fit, and only those rules run their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorsight.llm.registry import query, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: More rules than this are joined by a shuffle instead of a broadcast.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """``site``: ``host/path`` fits the host, its subdomains and paths that start so. ``glob``: fits anywhere, ``*`` is any text.

    Site rules go before globs; within a kind the longest text wins, then the first by text.
    """

    action: str
    text: str
    kind: str = "site"

    @property
    def pattern(self) -> str:
        parts = [re.escape(p) for p in self.text.split("*")] if self.kind == "glob" else [re.escape(self.text)]
        start = r"^(?:[^/]*\.)?" if self.kind == "site" else ""
        return "(?s)" + start + ".*".join(parts)

    @property
    def tokens(self) -> list[str]:
        """Words that every fitting URL holds between two delimiters; the empty word if there is none."""
        text, found = self.text.lower(), []
        for m in re.finditer("[a-z0-9]+", text):
            left = text[m.start() - 1] != "*" if m.start() else self.kind == "site"
            right = m.end() < len(text) and text[m.end()] != "*"
            if left and right:
                found.append(m[0])
        return sorted(set(found)) or [""]


SITE_RULES = (
    Rule("block", "net/"),
    Rule("allow", "example.net/en/"),
    Rule("block", "example.com/de/"),
    Rule("allow", "org/fr/"),
)
#: What the method adds where no site rule fits; everything else is allowed.
PATTERN_RULES = (
    Rule("block", "spam-farm.", "glob"),
    Rule("block", "/ads/", "glob"),
    Rule("block", "*/track/*.gif", "glob"),
    Rule("block", "/wp-login.php", "glob"),
    Rule("block", "casino.*/bonus/", "glob"),
    Rule("allow", "spam-farm.*/en/research/", "glob"),
)


def ranked(rules: Sequence[Rule]) -> list[Rule]:
    """From the weakest to the strongest."""
    return sorted(set(rules), key=lambda r: (r.kind == "site", len(r.text), [-ord(c) for c in r.text], r.action))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path; both empty without ``://`` or url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), path


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """``page_id, host, path, matched, verdict, site_rule`` for every row of ``pages`` (``page_id, url``).

    ``matched`` is the text of the strongest rule that fits, null if none does.
    A null url, or one without ``://``, has an empty host and path and gets ``default``.
    Repeated rows and null ids each keep a row; other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    words = F.split(F.translate(F.concat("host", "path"), UPPER, UPPER.lower()), "[^a-z0-9]+")
    urls = urls.withColumns({"row": F.monotonically_increasing_id(), "words": F.array_distinct(F.array_append(words, F.lit("")))})
    strength = list(enumerate(ranked(rules), 1))
    if not strength:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("matched"), F.lit(default).alias("verdict"), F.lit(False).alias("site_rule"))
    small = F.broadcast if len(strength) <= BROADCAST_RULES else (lambda df: df)
    listed = spark.createDataFrame([(i, r.pattern, r.text, r.action, r.kind == "site") for i, r in strength], "rank long, pattern string, matched string, verdict string, site_rule boolean")
    keys = spark.createDataFrame([(i, t) for i, r in strength for t in r.tokens], "rank long, word string")

    held = urls.select(F.explode("words").alias("word")).join(small(keys.select("word").distinct()), "word", "left_semi")
    counts = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = keys.join(counts, "word", "left").groupBy("rank").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("key"))
    index = rarest.select(F.col("key.word").alias("word"), "rank").join(listed.select("rank", "pattern"), "rank")

    tried = urls.withColumn("word", F.explode("words")).join(small(index), "word", "left")
    fits = F.when(F.rlike(F.concat("host", "path"), F.col("pattern")), F.col("rank"))
    # Partial aggregation folds a row's tokens before the only shuffle of the rows.
    best = tried.groupBy("row", "page_id", "host", "path").agg(F.max(fits).alias("rank"))
    return best.join(small(listed.drop("pattern")), "rank", "left").select(
        "page_id", "host", "path", "matched", F.coalesce("verdict", F.lit(default)).alias("verdict"), F.coalesce("site_rule", F.lit(False)).alias("site_rule")
    )


def _sql() -> str:
    rules = ",\n    ".join(f"({i}, '{r.pattern}', '{r.text}', '{r.action}', {r.kind == 'site'})" for i, r in enumerate(ranked(SITE_RULES + PATTERN_RULES), 1))
    return f"""with rules(rank, pattern, matched, verdict, site_rule) as (values {rules}),
rest as (select page_id, row_number() over () as r, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end, '') as rest from pages),
hosts as (select page_id, r, rest, regexp_extract(rest, '^[^/?#]*') as h from rest),
urls as (select page_id, r, translate(h, '{UPPER}', '{UPPER.lower()}') as host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from hosts),
best as (select u.page_id, u.host, u.path, u.r, max(x.rank) as rank from urls u
    left join rules x on regexp_matches(u.host || u.path, x.pattern) group by all)
select b.page_id, b.host, b.path, case when x.site_rule then x.matched end as rule, coalesce(x.verdict, 'allow') as verdict
from best b left join rules x on x.rank = b.rank"""


@query("op3_url_filters", _sql())
def op3_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's url against the site rules and, where none fits, the pattern rules."""
    judged = filter_urls(table(spark, sf, "pages"), SITE_RULES + PATTERN_RULES)
    return judged.select("page_id", "host", "path", F.when(F.col("site_rule"), F.col("matched")).alias("rule"), "verdict")
