"""URL filters: many pattern rules, each indexed by its rarest literal token.

A rule names the literal tokens that any url it matches must contain.  It is filed under the one that
is rarest in the corpus; a url's own tokens fetch the rules filed under them, and only those rules run
their regular expression.  Rules without a literal token are few and run on every url.

The token counts that choose the filing are summed over the whole table, but only for tokens that some
rule names, so that what comes to the driver is bounded by the rule list.  The index travels with the
function and has the size of the rule list.  There is no shuffle of urls and no grouping by host, so a
host with a third of all rows costs no more than any other.

Defined results: a null url, an empty one or one without ``://`` has an empty host and an empty path and
can match only rules that accept those; null ids and repeated rows keep their rows; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[0-9A-Za-z]+")


@dataclass(frozen=True)
class PathRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; of several the longest wins."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return r"\A(?:[^/]*\.)?" + re.escape(self.host) + re.escape(self.path)

    @property
    def literals(self) -> tuple[str, ...]:
        # The last run of the path may be cut off by its end, unless a delimiter follows it.
        whole = TOKEN.findall(self.host) + TOKEN.findall(re.sub(r"[0-9A-Za-z]+\Z", "", self.path))
        return tuple(t.lower() for t in whole)


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over ``host + path``, and tokens that every match has in host or path."""

    action: str
    name: str
    pattern: str
    literals: tuple[str, ...] = ()


#: The path rules of the production query.
PATH_RULES = (
    PathRule("allow", "com", "/"),
    PathRule("block", "example.com", "/en/"),
    PathRule("allow", "www.example.com", "/en/"),
    PathRule("block", "net", "/es/"),
    PathRule("block", "net", "/fr/"),
)

#: Judge urls that no path rule fits.
PATTERN_RULES = (
    PatternRule("block", "login-page", r"/wp-login\.php\b", ("wp", "login", "php")),
    PatternRule("block", "remote-procedure", r"/xmlrpc\.php\b", ("xmlrpc", "php")),
    PatternRule("block", "adult-host", r"\A(?:[^/]*\.)?xxx(?:/|\Z)", ("xxx",)),
    PatternRule("block", "casino-page", r"(?:\A|[./-])casino[./-]", ("casino",)),
    PatternRule("block", "cart-step", r"/cart/(?:add|checkout)\b", ("cart",)),
    PatternRule("block", "tag-listing", r"/tag/[^/]+/page/[0-9]+", ("tag", "page")),
    PatternRule("block", "address-literal", r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?:/|\Z)", ()),
)


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    stop = re.search(r"[/?#]", rest)
    host = rest if stop is None else rest[: stop.start()]
    path = "" if stop is None else re.split(r"[?#]", rest[stop.start() :], maxsplit=1)[0]
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(host: str, path: str) -> set[str]:
    return {t.lower() for t in TOKEN.findall(f"{host} {path}")}


class RuleIndex:
    """``rarity``: how often each literal token occurs in the corpus; unknown ones count as absent."""

    def __init__(self, path_rules: Iterable[PathRule], pattern_rules: Iterable[PatternRule], rarity: dict[str, int]):
        self.rules = [*((r, True) for r in path_rules), *((r, False) for r in pattern_rules)]
        self.filed: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        self.compiled = [re.compile(r.pattern) for r, _ in self.rules]
        for i, (rule, _) in enumerate(self.rules):
            if rule.literals:
                self.filed[min(rule.literals, key=lambda t: (rarity.get(t, 0), -len(t), t))].append(i)
            else:
                self.always.append(i)

    def candidates(self, host: str, path: str) -> list[int]:
        found = {i for t in tokens(host, path) if t in self.filed for i in self.filed[t]}
        return sorted(found.union(self.always))

    def judge(self, host: str, path: str) -> tuple[str | None, str, str | None]:
        """The path rule that wins, the verdict, and the pattern rule that decided if no path rule fits."""
        target, best, pattern = host + path, None, None
        for i in self.candidates(host, path):
            rule, is_path = self.rules[i]
            if not is_path and (best is not None or pattern is not None):
                continue
            if not self.compiled[i].search(target):
                continue
            if not is_path:
                pattern = rule
            elif best is None or len(rule.name) > len(best.name):
                best = rule
        if best is not None:
            return best.name, best.action, None
        return (None, "allow", None) if pattern is None else (None, pattern.action, pattern.name)


def token_counts(df: DataFrame, wanted: set[str], url: str = "url") -> dict[str, int]:
    """Urls of the whole table that contain each token of ``wanted``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for u in batch.column(0).to_pylist():
                seen.update(tokens(*parts(u)) & wanted)
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    partial = df.select(F.col(f"`{url}`").alias("url")).mapInArrow(count, "token string, n long")
    return {r["token"]: r["n"] for r in partial.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def build_index(df: DataFrame, path_rules: Iterable[PathRule] = PATH_RULES, pattern_rules: Iterable[PatternRule] = PATTERN_RULES, url: str = "url") -> RuleIndex:
    path_rules, pattern_rules = list(path_rules), list(pattern_rules)
    wanted = {t for r in [*path_rules, *pattern_rules] for t in r.literals}
    return RuleIndex(path_rules, pattern_rules, token_counts(df, wanted, url) if wanted else {})


def judge_urls(df: DataFrame, index: RuleIndex | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row for each input row: key, host, path, rule, verdict, and the pattern rule that decided."""
    index = index or build_index(df, url=url)
    kind = df.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [parts(u) for u in batch.column(1).to_pylist()]
            said = [index.judge(*x) for x in split]
            texts = [[x[0] for x in split], [x[1] for x in split], [x[0] for x in said], [x[1] for x in said], [x[2] for x in said]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in texts)], names=["key", "host", "path", "rule", "verdict", "pattern"])

    out = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url")).mapInArrow(judge, f"key {kind}, host string, path string, rule string, verdict string, pattern string")
    return out.withColumnRenamed("key", key)
