"""URL filters: pattern rules indexed by their rarest literal token, with DataFrame functions only.

A rule is written as a pattern in which `^` stands for a separator (any character but a letter or digit, or an end of
the URL), `*` for anything on the line, `||` in front for the start of the host or of one of its upper domains, `|` at the end for the
end of the URL, and the rest for itself. Runs of letters and digits with a separator on both sides are
its tokens: a URL can only match if they are among its own. Each rule is filed under the one that is rarest in the URLs
at hand; a URL's tokens fetch the rules to try, and only those run as regular expressions.

Null URLs, and URLs without `://`, have an empty host and path; a null URL matches no rule and is allowed. Repeated rows are judged
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules on host and path: (host, path, verdict). Fixed values of the query's contract.
SITE_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Pattern rules of the method: gambling, medicine adverts, trackers, adult sites, spam.
PATTERNS = (
    "^casino^", "^casinos^", "^casino-win^", "^poker^", "^bets^", "^free-bets^", "^betting^", "^jackpot^", "^pills^", "^cheap-pills^", "^viagra^", "^pharmacy-discount^",
    "^ads-track^", "^adserver^", "^ad-click^", "^click-track^", "^porn^", "^xxx^", "^sex-cam^", "^payday-loan^",
    "||ads.", "||adserver.", "||track.*^click^", "||casino*^bonus^", "||win*.casino.", "||cdn.*/banner/*.gif|", "||*.doubleclick.net^", "||click.*?*^redirect=",
    "/wp-content/*/ads/", "/out.php?*url=", "/redirect?*^target=http", "/popunder.js|", "/pixel.gif?", "/track/*/open.gif|", "?utm_campaign=*spam^", "&affid=*&subid=", "/slots/*/free^", "/loan*/apply^now^", "^adult^*^video^", "^replica^*^watches^",
)

#: Rules looked up through a literal map in the row, at most; a longer list is joined by token.
MAP_RULES = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def regex_of(pattern: str) -> str:
    """The pattern as a regular expression over the whole lower-cased URL."""
    out, rest, last = "", pattern, ""
    if rest.startswith("||"):
        # the host or one of its upper domains starts here
        out, rest = r"^[a-z][a-z0-9+.-]*://([^/?#]*[.])?", rest[2:]
    if rest.endswith("|"):
        rest, last = rest[:-1], "$"
    for i, c in enumerate(rest):
        if c == "^":
            out += "(^|[^a-z0-9])" if i == 0 and not out else "([^a-z0-9]|$)"
        else:
            out += "[^\\n]*" if c == "*" else re.escape(c)
    return out + last


def tokens_of(pattern: str) -> list[str]:
    """Literal tokens that every match has as whole tokens: next to separators or other punctuation on both sides."""
    # the mark of a host stands behind // or a dot, that of the end before the end
    return [m[0] for m in re.finditer(r"[a-z0-9]+", pattern) if m.start() > 0 and m.end() < len(pattern) and pattern[m.start() - 1] != "*" and pattern[m.end()] != "*"]


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without `://`."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    after = F.substring(rest, F.length(raw) + 1, F.length(rest))
    return _lower(raw), F.regexp_extract(after, r"\A[^?#]*", 0)


def site_rule(host: Column, path: Column, rules=SITE_RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none fits."""
    name, verdict = None, None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return name, verdict


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(_lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), ""))


def build_index(pages: DataFrame, patterns=PATTERNS, url_col: str = "url") -> dict[str, list[str]]:
    """token: patterns filed under it. Counts, over all URLs, only tokens that occur in the rules."""
    wanted = sorted({t for p in patterns for t in tokens_of(p)})
    if missing := [p for p in patterns if not tokens_of(p)]:
        raise ValueError(f"no literal token in {missing}")
    seen = pages.select(F.explode(F.array_intersect(url_tokens(F.col(url_col)), F.lit(wanted))).alias("t")).groupBy("t").count()
    counts = {r["t"]: r["count"] for r in seen.collect()}
    index: dict[str, list[str]] = {}
    for p in patterns:
        index.setdefault(min(tokens_of(p), key=lambda t: (counts.get(t, 0), t)), []).append(p)
    return index


def matches_any(url: Column, index: dict[str, list[str]]) -> Column:
    """Whether a rule of the index matches; only rules that the URL's tokens fetch are run."""
    pairs = [x for t, ps in index.items() for x in (F.lit(t), F.array(*[F.lit(regex_of(p)) for p in ps]))]
    by_token = F.create_map(*pairs)
    fetched = F.flatten(F.array_compact(F.transform(url_tokens(url), lambda t: F.try_element_at(by_token, t))))
    return F.exists(fetched, lambda r: F.regexp_like(_lower(F.coalesce(url, F.lit(""))), r))


def blocked_by_join(pages: DataFrame, index: dict[str, list[str]], url_col: str = "url") -> DataFrame:
    """Distinct URLs that a rule matches, for rule lists too long for a map: tokens join the index."""
    spark = pages.sparkSession
    rules = spark.createDataFrame([(t, regex_of(p)) for t, ps in index.items() for p in ps], "_t string, _r string")
    urls = pages.select(F.col(url_col).alias("_u")).where(F.col("_u").isNotNull()).distinct()
    return urls.select("_u", F.explode(url_tokens(F.col("_u"))).alias("_t")).join(rules, "_t").where(F.regexp_like(_lower(F.col("_u")), F.col("_r"))).select("_u").distinct()


def judge(pages: DataFrame, patterns=PATTERNS, site_rules=SITE_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict of every URL: the longest site rule decides, else the pattern rules."""
    index = build_index(pages, patterns, url_col)
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    name, verdict = site_rule(F.col("host"), F.col("path"), site_rules)
    if len(patterns) <= MAP_RULES:
        hit = matches_any(F.col("_url"), index)
    else:
        bad = blocked_by_join(pages, index, url_col).withColumn("_bad", F.lit(True))
        rows = rows.join(bad, rows["_url"] == bad["_u"], "left")
        hit = F.coalesce(F.col("_bad"), F.lit(False))
    return rows.select(id_col, "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(hit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def oracle_sql(patterns=PATTERNS, site_rules=SITE_RULES) -> str:
    """The same rows in plain SQL, trying every pattern on every URL."""
    tried = " or ".join(f"regexp_matches(lu, '{regex_of(p)}')" for p in patterns)
    fits = [(h + p, v, f"(host = '{h}' or host like '%.{h}') and path like '{p}%'") for h, p, v in sorted(site_rules, key=lambda r: -len(r[0] + r[1]))]
    rule = " ".join(f"when {c} then '{n}'" for n, _, c in fits)
    verdict = " ".join(f"when {c} then '{v}'" for _, v, c in fits)
    return f"""
with a as (select page_id, coalesce(url, '') u from pages),
b as (select page_id, u, case when strpos(u, '://') > 0 then substr(u, strpos(u, '://') + 3) else '' end r from a),
c as (select page_id, u, r, regexp_extract(r, '^[^/?#]*') h from b),
d as (select page_id, translate(u, '{UPPER}', '{LOWER}') lu, translate(h, '{UPPER}', '{LOWER}') host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') path from c)
select page_id, host, path, case {rule} end as rule, case {verdict} when {tried} then 'block' else 'allow' end as verdict from d"""
