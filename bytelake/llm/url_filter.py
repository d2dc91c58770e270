"""URL filter: host and path rules, then a blocked Bloom filter of listed urls and an exact join. DataFrame functions only."""

from __future__ import annotations

import functools
import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelake.llm import common as C

#: Rules: (verdict, host and path). The longest that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Bits of the filter for each listed url, bits of one block (four longs), bits set for one url.
BITS_A_URL, BLOCK_BITS, PROBES = 12, 256, 6
#: Blocks up to which the filter is broadcast: 40 bytes each, about 40 MB.
BROADCAST_BLOCKS = 1 << 20


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end."""
    part = lambda i: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return _lower(part(1)), part(2)


def canonical(url: Column) -> Column:
    """Host without www., path without slashes or .html at its end, and the query without tracking
    parameters; scheme and fragment go. Null and urls without :// give null."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref|fbclid|gclid)(=|$)"))), "&")
    short = F.regexp_replace(F.regexp_replace(path, r"(\.html)?/*$", ""), r"/+$", "")
    return F.when(url.contains("://"), F.concat(F.regexp_replace(host, r"^www\.", ""), short, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def on_host(host: Column, name: str) -> Column:
    return (host == name) | host.endswith(f".{name}")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Of the rules that fit, the longest, as struct(verdict, rule); null if none fits."""
    longest = sorted(rules, key=lambda r: -len(r[1]))
    fits = [(on_host(host, r.partition("/")[0]) & path.startswith("/" + r.partition("/")[2]), F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule"))) for v, r in longest]
    return functools.reduce(lambda c, x: c.when(*x), fits[1:], F.when(*fits[0]))


def _probe(h: Column, blocks: int) -> list[Column]:
    """Block of a url, and the bits it sets in each of the block's four longs."""
    bits = [F.pmod(F.shiftright(F.xxhash64(h, F.lit("bit")), 8 * i), F.lit(BLOCK_BITS)) for i in range(PROBES)]
    word = lambda w: functools.reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.shiftright(p, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long")) for p in bits])
    return [F.pmod(h, F.lit(blocks)).alias("block"), *(word(w).alias(f"w{w}") for w in range(4))]


def listed_urls(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """canonical: canonical urls under which the pages of a crawl show more than one content: the address says nothing of
    what is there (spinning pages, cloaking, hijacked addresses).

    All pages of such a url (other scheme, www., slash, tracking parameters) are listed by it. Null html is empty; urls
    that are null or without :// aren't listed; repeated rows show one content; an empty table gives no rows. A url
    with very many pages is reduced to two hashes in each task before they meet.
    """
    shown = F.xxhash64(F.coalesce(F.col(html).cast("string"), F.lit("")))
    rows = pages.select(canonical(F.col(url).cast("string")).alias("canonical"), shown.alias("h")).where("canonical IS NOT NULL")
    return rows.groupBy("canonical").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("canonical")


def block_listed(urls: DataFrame, listed: DataFrame, url: str = "canonical") -> DataFrame:
    """urls with a boolean column listed: whether their canonical url is in listed(canonical). Nulls aren't.

    A Bloom filter with one block for each url (all its bits in one row of four longs, so one probe a url) lets
    through every listed url and few others. Only those go on to an exact join on the url's hash and text; what the
    filter stops is done, and isn't shuffled. The filter is broadcast up to BROADCAST_BLOCKS blocks and joined by
    a shuffle beyond. Equal urls, however many, meet one row of the list.
    """
    rows = C.materialize(listed.select(F.col(url).alias("_u")).where("_u IS NOT NULL").distinct().withColumn("_h", F.xxhash64("_u")))
    blocks = max(1, math.ceil(rows.count() * BITS_A_URL / BLOCK_BITS))
    filled = rows.select(*_probe(F.col("_h"), blocks)).groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"f{w}") for w in range(4))).withColumnRenamed("block", "_b")
    small = blocks <= BROADCAST_BLOCKS
    asked = urls.withColumn("_h", F.xxhash64(F.col(url)))
    b, *words = _probe(F.col("_h"), blocks)
    asked = asked.withColumns({"_block": b} | {f"_w{i}": w for i, w in enumerate(words)})
    asked = asked.join(F.broadcast(filled) if small else filled, F.col("_block") == F.col("_b"), "left")
    may = functools.reduce(lambda x, y: x & y, [F.col(f"_w{i}").bitwiseAND(F.col(f"f{i}")) == F.col(f"_w{i}") for i in range(4)])
    asked = asked.withColumn("_may", F.coalesce(may & F.col(url).isNotNull(), F.lit(False))).select(*urls.columns, "_h", "_may")
    stopped = asked.where(~F.col("_may")).select(*urls.columns, F.lit(False).alias("listed"))
    found = rows.select(F.col("_h").alias("_lh"), "_u", F.lit(True).alias("_in"))
    passed = asked.where("_may").join(found, (F.col("_h") == F.col("_lh")) & (F.col(url) == F.col("_u")), "left")
    return stopped.unionByName(passed.select(*urls.columns, F.coalesce("_in", F.lit(False)).alias("listed")))


def judge_urls(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    The longest rule that fits host and path decides; where none fits, urls whose canonical form is in
    listed(canonical) are blocked and others allowed. A null url or one without :// has empty host and path, fits no
    rule and is allowed. Repeated rows are judged each; null ids stay; an empty table gives no rows; other columns
    are ignored.
    """
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("_url"))
    rows = rows.withColumns({"host": host, "path": path, "canonical": canonical(F.col("_url"))}).drop("_url")
    judged = block_listed(rows, listed).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )


_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"


_LONGEST = sorted(RULES, key=lambda r: -len(r[1]))
SQL = f"""
WITH p AS (
  SELECT page_id, {_HOST} AS host, {_PATH} AS path, url, html,
    list_aggregate(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), 'string_agg', '&') AS q
  FROM pages),
c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www\\.', '')
    || regexp_replace(regexp_replace(path, '(\\.html)?/*$', ''), '/+$', '')
    || CASE WHEN coalesce(q, '') <> '' THEN '?' || q ELSE '' END END AS canonical FROM p),
l AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY 1 HAVING min(coalesce(html, '')) <> max(coalesce(html, ''))),
j AS (SELECT c.*, l.canonical IS NOT NULL AS listed,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in _LONGEST)} END AS rule FROM c LEFT JOIN l ON c.canonical = l.canonical)
SELECT page_id, host, path, rule,
  CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in _LONGEST)} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM j
"""
