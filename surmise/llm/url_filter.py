"""URL filters: allow/block rules, and logistic regression on hashed character n-grams of host and path.

Scoring is a Catalyst expression over the url column alone: no shuffle, no Python on the executors.
The model is fitted on the driver from a small labelled table whose size is checked.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by the
model's bias alone; repeated rows and equal ids are judged row by row; an empty table gives an empty
result; a null id stays null; extra columns are ignored, and one named like an output is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM, BUCKETS, PATH_SALT = 4, 16384, 977
MAX_LABELLED = 100_000


@dataclass(frozen=True)
class Rule:
    """``host + path`` prefix; it fits the host and its subdomains."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


@dataclass(frozen=True)
class UrlModel:
    bias: float
    weights: tuple[float, ...]


def split_url(url: str | None) -> tuple[str, str]:
    """The driver's counterpart of ``host_and_path``, for training and tests."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.translate(str.maketrans(UPPER, LOWER)), rest[:cut]


def buckets(host: str, path: str) -> list[int]:
    """Hash buckets of the n-grams of ``^host$`` and ``^path$``."""
    out = []
    for text, salt in ((f"^{host}$", 0), (f"^{path}$", PATH_SALT)):
        code = [ord(c) for c in text]
        for i in range(len(code) - GRAM + 1):
            h = salt
            for c in code[i : i + GRAM]:
                h = (h * 31 + c) % 1_000_003
            out.append(h % BUCKETS)
    return out


def fit(labelled: Sequence[tuple[str, int]], rounds: int = 1500, rate: float = 1.0, ridge: float = 3e-4) -> UrlModel:
    """Full-batch gradient descent in which both labels weigh the same; weights are rounded so that they print exactly."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled table is meant to be small: at most {MAX_LABELLED} rows")
    found = [buckets(*split_url(url)) for url, _ in labelled]
    used = sorted(set().union(*found))  # the others stay 0
    column = {bucket: i for i, bucket in enumerate(used)}
    x = np.zeros((len(labelled), len(used)))
    for row, own in enumerate(found):
        np.add.at(x[row], [column[k] for k in own], 1.0)
    y, w, b = np.array([label for _, label in labelled], float), np.zeros(len(used)), 0.0
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
        w -= rate * (x.T @ g + ridge * w)
        b -= rate * g.sum()
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return UrlModel(round(float(b), 4), tuple(round(float(v), 4) for v in weights))


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(tail, r"^[^?#]*", 0)


def _logit(model: UrlModel, host: str, path: str) -> Column:
    weights = ",".join(repr(w) for w in model.weights)
    terms = []
    for name, salt in ((host, 0), (path, PATH_SALT)):
        text = f"concat('^', {name}, '$')"
        h = str(salt)
        for k in range(GRAM):
            h = f"(({h}) * 31L + ascii(substring({text}, i + {k}, 1))) % 1000003L"
        # '^' and '$' alone make two characters, so short texts may have no n-gram at all
        starts = f"if(length({text}) >= {GRAM}, sequence(1, length({text}) - {GRAM - 1}), array())"
        terms.append(f"aggregate(transform({starts}, i -> cast(({h}) % {BUCKETS}L AS int)), 0D, (s, b) -> s + try_element_at(weights, b + 1))")
    return F.expr(f"{model.bias!r}D + " + " + ".join(terms).replace("weights", f"split('{weights}', ',')::array<double>"))


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[Rule], url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, score and verdict.  The longest fitting rule decides; without one, the model does."""
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    score = 1 / (1 + F.exp(-_logit(model, "host", "path")))
    out = out.withColumns({"rule": rule, "score": score})
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")))


def judge_sql(model: UrlModel, rules: Sequence[Rule]) -> str:
    """The same over the table ``pages`` in DuckDB's SQL, without the score."""
    logit = -math.inf if not model.weights else model.bias
    terms = []
    for name, salt in (("host", 0), ("path", PATH_SALT)):
        text = f"('^' || {name} || '$')"
        h = str(salt)
        for k in range(GRAM):
            h = f"(({h}) * 31 + unicode(substr({text}, i + {k}, 1))) % 1000003"
        terms.append(f"coalesce(list_sum(list_transform(range(1, length({text}) - {GRAM - 2}), lambda i: w[(({h}) % {BUCKETS} + 1)::int])), 0)")
    fits = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules}
    longest = sorted(rules, key=lambda r: -len(r.text))
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r.text}'" for r in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r.verdict}'" for r in longest) + " WHEN logit >= 0 THEN 'block' ELSE 'allow' END"
    return f"""
WITH model AS (SELECT [{",".join(repr(w) for w in model.weights)}]::DOUBLE[] AS w),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT page_id, host, path, {logit!r} + {" + ".join(terms)} AS logit FROM c, model)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM d"""
