"""URL filters in DataFrame functions alone: rules first, then a logistic regression on hashed character n-grams.

A rule is a host and a path; it fits its host and all subdomains if the url's path starts with the rule's, and the longest
fitting rule decides. Where none fits, the sum of the weights of the n-grams of host and path does. The weights come from
a small labelled table that is part of this module: a few hundred urls of invented hosts, whose size doesn't depend on the
input. They are fitted on the driver in plain Python, once per process, and enter the plan as one literal array, so scoring is a
projection: no join, no shuffle, no Python on executors.

Defined cases: null urls and urls without "://" have an empty host and path, fit no rule, and are judged by the method;
repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789abcdef"
SIZES = (3, 4)
BUCKETS = 4096
BLOCK_AT = 1.5  # the logit from which the method blocks: a probability of about 0.82

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

UNWANTED = """casino poker slots jackpot betting free-bets sportsbet lottery win-prize roulette pills cheap-meds pharmacy viagra
cialis diet-pills adult xxx porn sex-cams escorts hot-singles ads track adserver click-ads popads banner-ads adtracker
spam link-farm spam-blog seo-links content-farm warez cracks keygen torrents pirated replica-watches fake-bags payday
quick-loans easy-money get-rich free-money crypto-double malware phish login-verify free-gift casino-win cheap-pills""".split()
WANTED = """garden news weather recipes museum library science history travel maps music school college research health
sports forum wiki docs news-daily letters journal review market bakery kitchen cycling hiking railway harbour mountain
river forest village town-hall council theatre cinema painting physics biology chemistry mathematics geology astronomy
grammar dictionary poetry novels authors archive records letters open-data software kernel compiler database python-tips
city-guide home-repair used-books farm-shop tracking-birds family-doctor win-dows adult-education""".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: (url, 1 to block, 0 to allow). Top-level names, languages and numbers are alike in both classes."""
    tops, subs = ("example.com", "example.net", "example.org"), ("", "www.", "blog.", "m.")
    langs, ends = ("en", "de", "fr", "es"), ("", "/", ".html")
    syllables = ("th", "er", "an", "tion", "ka", "lo", "mi", "ren", "sol", "tu", "ble", "ha", "wh", "ou", "ing", "est", "at", "nt", "re", "de", "os", "ve")
    digest = lambda i: hashlib.md5(f"host {i}".encode()).digest()
    made = ["".join(syllables[b % len(syllables)] for b in digest(i)[: 2 + i % 3]) for i in range(160)]
    rows = []
    for label, names in ((1, UNWANTED), (0, WANTED), (0, made)):
        for i, name in enumerate(names):
            for j in range(3):
                k = i + 5 * j
                rows.append((f"https://{subs[k % 4]}{name}.{tops[(k // 2) % 3]}/{langs[k % 4]}/{(k * 7919) % 50000}{ends[k % 3]}", label))
            if i % 4 == 0:
                rows.append((f"http://host{i}.{tops[i % 3]}/{name}/{i * 31 % 977}.html", label))
    return rows


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the DataFrame functions give them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(str.maketrans(UPPER, LOWER)), tail[:cut]


def grams(host: str, path: str) -> list[int]:
    """Buckets of the character n-grams of host and path, repeats included."""
    out = []
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in SIZES:
            out.extend(int(hashlib.md5(f"{kind}{text[i : i + n]}".encode()).hexdigest()[:3], 16) for i in range(len(text) - n + 1))
    return out


@functools.cache
def weights(rounds: int = 60, rate: float = 0.05, l2: float = 1e-3) -> tuple[tuple[float, ...], float]:
    """The fitted weights and bias, rounded to six places, by stochastic gradient descent in a fixed order."""
    rows = [(Counter(grams(*split_url(url))), label) for url, label in labelled_urls()]
    up = sum(label for _, label in rows)
    cost = (len(rows) / (2 * (len(rows) - up)), len(rows) / (2 * up))
    w, bias = [0.0] * BUCKETS, 0.0
    for t in range(rounds):
        step = rate / (1 + t / 30)
        for i in range(len(rows)):
            found, label = rows[(i * 101 + t) % len(rows)]
            z = bias + sum(w[g] * n for g, n in found.items())
            error = cost[label] * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label)
            bias -= step * error
            for g, n in found.items():
                w[g] -= step * (error * n + l2 * w[g])
    return tuple(round(x, 6) for x in w), round(bias, 6)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.char_length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as host and path, and its verdict; both null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def block_logit(host: Column, path: Column) -> Column:
    """The logit of blocking: the bias plus the weights of all n-grams."""
    values, bias = weights()
    table = F.split(F.lit(" ".join(map(str, values))), " ").cast("array<double>")
    digit = lambda g, i: F.instr(F.lit(DIGITS), F.substring(g, i, 1)) - 1
    total = F.lit(bias)
    for kind, part in (("h", host), ("p", path)):
        text = F.concat(F.lit("^"), part, F.lit("$"))
        for n in SIZES:
            last = F.char_length(text) - n + 1
            starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
            hashes = F.transform(starts, lambda i: F.md5(F.concat(F.lit(kind), F.substring(text, i, F.lit(n)))))  # noqa: B023
            total = total + F.aggregate(hashes, F.lit(0.0), lambda acc, g: acc + F.get(table, digit(g, 1) * 256 + digit(g, 2) * 16 + digit(g, 3)))
    return total


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, probability of blocking by the method) of every page."""
    host, path = parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    name, what = rule_for(F.col("host"), F.col("path"), rules)
    scored = split.select("id", "host", "path", name.alias("rule"), what.alias("by_rule"), block_logit(F.col("host"), F.col("path")).alias("logit"))
    verdict = F.coalesce("by_rule", F.when(F.col("logit") >= BLOCK_AT, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("id", "host", "path", "rule", verdict.alias("verdict"), (1 / (1 + F.exp(-F.col("logit")))).alias("probability"))


def judge_sql(rules: list[tuple[str, str, str]] = RULES) -> str:
    """The same over a view ``pages``, as DuckDB SQL: page_id, host, path, rule, verdict."""
    values, bias = weights()
    by_length = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(h, p, v)}'" for h, p, v in by_length) + " END"
    digit = lambda i: f"(strpos('{DIGITS}', substr(md5(g), {i}, 1)) - 1)"
    lists = ", ".join(f"list_transform(range(1, greatest(length({part}) + 2 - {n}, 0) + 1), lambda i: '{kind}' || substr('^' || {part} || '$', i, {n}))" for kind, part in (("h", "host"), ("p", "path")) for n in SIZES)
    return f"""
WITH w AS (SELECT [{", ".join(map(str, values))}]::DOUBLE[] AS v),
t AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM t),
s AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
z AS (SELECT page_id, host, path, {bias} + list_sum(list_transform(flatten([{lists}]), lambda g: v[{digit(1)} * 256 + {digit(2)} * 16 + {digit(3)} + 1])) AS logit FROM s CROSS JOIN w)
SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule,
       coalesce({case(lambda h, p, v: v)}, CASE WHEN logit >= {BLOCK_AT} THEN 'block' ELSE 'allow' END) AS verdict
FROM z"""
