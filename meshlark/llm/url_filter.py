"""URL filters: rules by host and path, then logistic regression on hashed character n-grams.

Everything on the scoring path is built from DataFrame expressions.  A URL is cut
into host and path; the character 3-grams of both (host and path hashed apart)
fall into ``buckets`` by a polynomial of their code points, and the verdict is the
sign of the summed bucket weights.  Weights are whole numbers (logistic weights
times 1024, rounded), so that sums are exact in any order and in any engine.

``train`` fits the weights on a small labelled URL table (at most ``MAX_LABELLED``
rows, checked) on the driver, with L2.  The default table is made by rule from two word
lists (``labelled``), and its site names are none of the judged tables'.

Rules are rows (verdict, host, path).  A rule fits its host and all subdomains if
the path starts with the rule's path; the longest rule (host and path together)
wins, ties going to block, then to the smaller text.  Up to ``INLINE_RULES`` rules
become one CASE expression; more are joined on the host's suffixes, with the rules
broadcast only below ``BROADCAST_RULES`` rows, and beyond it by a shuffled join in
which each URL carries a salt that spreads a hot suffix.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits
no rule and is judged by the bias alone; empty strings have no n-grams; very long
URLs are judged whole; repeated rows are judged each; other input columns are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
INLINE_RULES = 256
BROADCAST_RULES = 100_000
SALTS = 16
BUCKETS = 8191
SCALE = 1024

#: Words that site names of the labelled table are made of (the author's own choice; no site name of any table).
TELLING = "poker roulette jackpot slots lotto prize bingo wager gamble loans payday credit cash crypto forex pharmacy viagra diet slim xxx porn nude escort singles dating cams hot girls warez crack keygen torrent serial replica rolex outlet coupon deals click popup banner spyware phish malware virus hack bonus rich".split()
PLAIN = "library garden news docs university museum recipes weather wiki history science maps school theatre harbour nation foundation education brother lantern northern bakery railway poetry research journal market council health music sports travel photo forum support learn code software kernel data cloud academy hospital energy climate biology physics law review daily times post report city town island river mountain forest coffee kitchen design studio books press radio games chess cycling running yoga family kids baby pet bird flower paper stack overflow hub encyclopedia archive commons source project open linux python".split()
#: Well-known sites, all to be allowed.
KNOWN = "wikipedia github arxiv stackoverflow nytimes bbc reuters mozilla debian apache nature pubmed loc archive python kernel".split()
_SYLLABLES = "ba ke lo mi nu ra se ti vo wa che dri fla gre plo sta tri whe hor lan mer son cha".split()
_ENDINGS = ("", "tion", "ing", "er", "ly", "ness", "ment", "ful")
_SHAPES = ("http://{}.com/en/4033.html", "https://m.{}.net/de/17#top", "https://www.{}.org/fr/1291/", "http://blog.{}.example.net/en/52?utm_source=feed", "https://{}.co.uk/2021/05/a-page?page=2&ref=x", "https://en.{}.org/wiki/Page", "http://{}.example.com/de/8423")


def names(turn: int) -> tuple[list[str], list[str]]:
    """Site names to be blocked and to be allowed; another ``turn`` gives other names of the same words (0 is trained on)."""
    n, m = len(TELLING), len(PLAIN)
    blocked = [f"{TELLING[i]}-{TELLING[(i + 5 + turn) % n]}" for i in range(n)] + [f"{PLAIN[(3 * i + turn) % m]}{TELLING[i]}" for i in range(n)] + [f"{TELLING[i]}-{PLAIN[(5 * i + 11 + turn) % m]}" for i in range(n)]
    allowed = [f"{PLAIN[i]}-{PLAIN[(i + 7 + turn) % m]}" for i in range(m)] + [f"{PLAIN[i]}{PLAIN[(2 * i + 1 + turn) % m]}" for i in range(m)]
    made = lambda i: "".join(_SYLLABLES[(i * k + k + turn) % len(_SYLLABLES)] for k in (1, 3, 7)[: 2 + i % 2])
    allowed += [made(i) + _ENDINGS[(i + turn) % len(_ENDINGS)] for i in range(360)]
    if turn == 0:
        blocked, allowed = blocked + TELLING, allowed + PLAIN + KNOWN
    return list(dict.fromkeys(blocked)), list(dict.fromkeys(allowed))


def labelled(turn: int = 0) -> list[tuple[str | None, int]]:
    """The labelled URL table: 1 is to be blocked.  Each name has one URL, and there is one URL without host and path."""
    both = [(name, label) for label, found in zip((1, 0), names(turn), strict=True) for name in found]
    return [(None, 0)] + [(_SHAPES[i % len(_SHAPES)].format(name), label) for i, (name, label) in enumerate(both)]


#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return _ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as plain Python, for the driver-side fit and for tests."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ngrams(host: str, path: str, buckets: int = BUCKETS) -> list[int]:
    out = []
    for seed, text in ((0, f"^{host}$"), (7, f"^{path}$")):
        out += [(seed + 961 * ord(text[i]) + 31 * ord(text[i + 1]) + ord(text[i + 2])) % buckets for i in range(len(text) - 2)]
    return out


def train(rows: list[tuple[str | None, int]] | None = None, *, buckets: int = BUCKETS, steps: int = 1500, rate: float = 0.5, l2: float = 2e-4) -> tuple[list[int], int]:
    """Bucket weights and bias, as whole numbers (times SCALE), by full-batch gradient descent on the driver."""
    rows = labelled() if rows is None else rows
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled URL table has {len(rows)} rows; the bound is {MAX_LABELLED}")
    found = [ngrams(*split_url(u), buckets) for u, _ in rows]
    owner, gram = np.repeat(np.arange(len(rows)), [len(g) for g in found]), np.array([g for x in found for g in x], dtype=np.int64)
    wanted, weights, bias = np.array([float(y) for _, y in rows]), np.zeros(buckets), 0.0
    for _ in range(steps if rows else 0):
        odds = bias + np.bincount(owner, weights=weights[gram], minlength=len(rows))
        wrong = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - wanted
        weights = weights - rate * (np.bincount(gram, weights=wrong[owner], minlength=buckets) / len(rows) + l2 * weights)
        bias -= rate * float(wrong.mean())
    return [round(w * SCALE) for w in weights.tolist()], round(bias * SCALE)


@functools.cache
def default_model() -> tuple[list[int], int]:
    return train()


def score(host: Column, path: Column, weights: list[int], bias: int) -> Column:
    """Summed weights of the n-grams, times SCALE; above 0 means block."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # folded into one constant

    def of(text: Column, seed: int) -> Column:
        points = F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: F.ascii(c))
        gram = F.transform(
            F.arrays_zip(F.slice(points, 1, F.size(points) - 2).alias("a"), F.slice(points, 2, F.size(points) - 2).alias("b"), F.slice(points, 3, F.size(points) - 2).alias("c")),
            lambda x: F.element_at(table, ((F.lit(seed) + 961 * x["a"] + 31 * x["b"] + x["c"]) % len(weights)) + 1),
        )
        return F.aggregate(gram, F.lit(0).cast("long"), lambda acc, w: acc + w)

    return of(host, 0) + of(path, 7) + F.lit(bias)


def _ordered(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, model: tuple[list[int], int] | None = None) -> DataFrame:
    """Per row: id, host, path, rule, score (log-odds), verdict."""
    rules = RULES if rules is None else rules
    weights, bias = model or default_model()
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if len(rules) <= INLINE_RULES:
        host, path = F.col("host"), F.col("path")
        verdict = rule = None
        for said, h, p in _ordered(rules):
            fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
            verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
            rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        rows = rows.withColumn("rule", rule if rule is not None else F.lit(None).cast("string")).withColumn("said", verdict if verdict is not None else F.lit(None).cast("string"))
    else:
        rows = _joined(rows, rules)
    own = score(F.col("host"), F.col("path"), weights, bias)
    rows = rows.withColumn("score", own / F.lit(SCALE))
    return rows.select(id_col, "host", "path", "rule", "score", F.coalesce("said", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"))


def _joined(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Many rules: each URL meets the rules of its host's suffixes (no more labels than any rule has)."""
    spark = rows.sparkSession
    most = max(h.count(".") + 1 for _, h, _ in rules)
    table = spark.createDataFrame([(h, p, said, i) for i, (said, h, p) in enumerate(_ordered(rules))], "rule_host string, rule_path string, said string, place int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    keyed = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("salt", (F.col("row") % SALTS).cast("int"))
    if len(rules) <= BROADCAST_RULES:
        found = keyed.withColumn("rule_host", F.explode(suffixes)).join(F.broadcast(table), "rule_host")
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = keyed.withColumn("rule_host", F.explode(suffixes)).join(salted, ["rule_host", "salt"])
    best = found.where(F.col("path").startswith(F.col("rule_path"))).groupBy("row").agg(F.min_by(F.struct("said", F.concat("rule_host", "rule_path").alias("rule")), "place").alias("best"))
    return keyed.join(best, "row", "left").select(*rows.columns, F.col("best.rule").alias("rule"), F.col("best.said").alias("said"))


def oracle() -> str:
    """The default rules and model as SQL for DuckDB."""
    weights, bias = default_model()

    def of(text: str, seed: int) -> str:
        return f"list_sum(list_transform(range(1, length({text}) + 1), lambda i: w[({seed} + 961 * unicode(substr('^' || {text} || '$', i, 1)) + 31 * unicode(substr('^' || {text} || '$', i + 1, 1)) + unicode(substr('^' || {text} || '$', i + 2, 1))) % {len(weights)} + 1]))"

    fits = [(said, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for said, h, p in _ordered(RULES)]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[k]}'" for f in fits) + " END"
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT {weights} AS w),
s AS (SELECT page_id, host, path, coalesce({of("host", 0)}, 0) + coalesce({of("path", 7)}, 0) + ({bias}) AS points FROM h, m)
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(0)}, CASE WHEN points > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM s
"""
