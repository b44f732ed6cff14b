"""URL filters: host and path rules, and a blocked Bloom filter of listed URLs in front of an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import register
from .store import stored

WORDS = 8              # 32-bit words of a block; every URL sets one bit in each
BITS_PER_URL = 16      # about 0.1 % false positives
BLOCKS_AT_ONCE = 1 << 20  # blocks (of 40 bytes) up to which the filter is broadcast; beyond, it meets the URLs in a shuffle

# fixed values: rules of the registered query, (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
# fixed values: query parameters that do not change the page
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Comparable form: no scheme, ``www.``, default port, fragment, tracking parameters or closing slash; parameters sorted.

    Null if there is no ``://``.
    """
    h = F.regexp_replace(F.regexp_replace(host(url), r":(80|443)$", ""), r"^www\.", "")
    p = F.regexp_replace(path(url), "/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.substring_index(x, "=", 1).isin(*TRACKING))
    q = F.array_join(F.sort_array(kept), "&")
    return F.when(_rest(url).isNotNull(), F.concat(h, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def rule_for(h: Column, p: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host (or a parent domain) and path; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rh, rp in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((h == rh) | F.endswith(h, F.lit("." + rh))) & F.startswith(p, F.lit(rp))
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _block_and_bits(key: Column, blocks: int) -> list[Column]:
    """Block number, and for every word of the block the mask of the one bit the key sets there."""
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"),
            *[F.call_function("shiftleft", F.lit(1), F.pmod(F.xxhash64(key, F.lit(k)), F.lit(31)).cast("int")).alias(f"w{k}") for k in range(WORDS)]]


def bloom_filter(listed: DataFrame, key: str, rows: int) -> DataFrame:
    """Blocked Bloom filter of a list: one row per used block, ``w0`` … ``w7``. Partial aggregation makes it one row per block and task."""
    blocks = max(1, rows * BITS_PER_URL // (31 * WORDS))
    bits = listed.select(*_block_and_bits(F.col(key), blocks))
    return bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", list_col: str = "url") -> DataFrame:
    """``id``, ``host``, ``path``, ``canonical``, ``rule``, ``listed`` and ``verdict`` of every page, one row each.

    A rule that fits decides. Otherwise a URL whose canonical form is listed is blocked, every other allowed. Listed URLs are
    canonicalised and made distinct, then hashed into a blocked Bloom filter; only URLs whose bits are all set (and that no
    rule decides) go to the exact join on the canonical form, so the long strings of the rest never move. A filter of more than
    BLOCKS_AT_ONCE blocks meets the hashes in a shuffle instead of a broadcast.

    Null or malformed URL (no ``://``): empty host and path, not listed, allowed. Repeated rows and ids stay. Empty list: nothing is listed.
    """
    urls = stored(listed.select(canonical(F.col(list_col)).alias("canonical")).filter("canonical is not null").distinct(), "url-list")
    rows = urls.count()
    u = F.col("u")
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("u")).select(
        "id", host(u).alias("host"), path(u).alias("path"), canonical(u).alias("canonical"))
    p = p.withColumn("r", rule_for(F.col("host"), F.col("path"), rules)).select("id", "host", "path", "canonical", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("by_rule"))
    blocks = max(1, rows * BITS_PER_URL // (31 * WORDS))
    sketch = bloom_filter(urls, "canonical", rows)
    sketch = F.broadcast(sketch) if blocks <= BLOCKS_AT_ONCE else sketch
    bits = [c for c in _block_and_bits(F.col("canonical"), blocks)]
    key = p.select("*", bits[0], F.struct(*bits[1:]).alias("bits"))
    hit = F.lit(True)
    for k in range(WORDS):
        hit = hit & (F.col(f"w{k}").bitwiseAND(F.col(f"bits.w{k}")) == F.col(f"bits.w{k}"))
    tested = key.join(sketch, "block", "left").withColumn("possible", F.coalesce(hit & F.col("by_rule").isNull() & F.col("canonical").isNotNull(), F.lit(False)))
    tested = tested.select("id", "host", "path", "canonical", "rule", "by_rule", "possible")
    sure = tested.filter("possible").join(urls.withColumn("found", F.lit(True)), "canonical", "left").select(
        "id", "host", "path", "canonical", "rule", "by_rule", F.coalesce("found", F.lit(False)).alias("listed"))
    rest = tested.filter("not possible").select("id", "host", "path", "canonical", "rule", "by_rule", F.lit(False).alias("listed"))
    both = sure.unionByName(rest)
    return both.withColumn("verdict", F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow"))).drop("by_rule")


# fixed values: the list of the registered query holds the addresses of hosts with these name parts, and those with these endings
LISTED_PARTS = ("spam", "pills", "casino", "cheap")
LISTED_PATHS = (".html",)


def _sql_canonical(u: str = "url") -> str:
    rest = f"substr({u}, strpos({u}, '://') + 3)"
    names = ", ".join(f"'{t}'" for t in TRACKING)
    return (f"CASE WHEN strpos({u}, '://') > 0 THEN regexp_replace(regexp_replace(_h, ':(80|443)$', ''), '^www\\.', '') || regexp_replace(_p, '/+$', '') || "
            f"coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract({rest}, '^[^?#]*\\?([^#]*)', 1), '&'), "
            f"lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({names}))), '&'), ''), '') END")


def _sql_oracle() -> str:
    rest = "substr(url, strpos(url, '://') + 3)"
    fits = lambda rh, rp: f"(host = '{rh}' OR ends_with(host, '.{rh}')) AND starts_with(path, '{rp}')"
    order = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in order)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in order)
    parts = " OR ".join([f"contains(_h, '{x}')" for x in LISTED_PARTS] + [f"ends_with(_p, '{x}')" for x in LISTED_PATHS])
    return f"""WITH cut AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS _h,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS _p FROM pages),
p AS (SELECT page_id, _h AS host, _p AS path, {parts} AS pick, {_sql_canonical()} AS canonical FROM cut),
l AS (SELECT DISTINCT canonical FROM p WHERE pick AND canonical IS NOT NULL)
SELECT page_id, host, path, CASE {rule} END AS rule,
  coalesce(CASE {verdict} END, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN l ON p.canonical = l.canonical"""


@register("op1_url_filter", _sql_oracle())
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds addresses of the table itself: those of hosts with a listed name part, and those with a listed path ending."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    h, p = host(F.col("url")), path(F.col("url"))
    pick = F.lit(False)
    for x in LISTED_PARTS:
        pick = pick | F.contains(h, F.lit(x))
    for x in LISTED_PATHS:
        pick = pick | F.endswith(p, F.lit(x))
    out = url_filter(pages, pages.filter(pick))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")
