"""URL filters: pattern rules found by their rarest literal token.

A rule is a pattern over ``host + path`` or the whole url, compiled to a regular
expression. Each rule is filed under the one of its literal tokens that is
rarest among the urls, counted by Spark; a url's tokens fetch the rules to try,
and only those run. Host rules (a host with its subdomains, and the start of a
path) decide first, the longest winning; other urls go to the pattern rules,
where an exception beats a block, and what no rule fits is allowed.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.work import own_columns, settled, small

TOKEN = re.compile(r"[a-z0-9%]+")
_UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
#: A worker holds so many rules; longer lists take a pass over the distinct urls for each such part.
RULES_AT_ONCE = 100_000
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """action: allow or block. pattern: of a host rule ``host/path``; of others a text in which ``*`` stands for anything, ``^`` for a separator or the end, and ``||`` in front for the start of the host or of a label of it."""

    action: str
    pattern: str
    is_host: bool = False

    @property
    def regex(self) -> str:
        if self.is_host:
            return r"^(?:[^/]*\.)?" + re.escape(self.pattern)
        body = self.pattern.removeprefix("||")
        head = r"^(?:[^/]*\.)?" if self.pattern.startswith("||") else ""
        return head + "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in body)

    def tokens(self) -> list[str]:
        """Literal runs that any fitting url has as whole tokens: those with a separator, or the start of a label, on both sides."""
        text = self.pattern.removeprefix("||").translate(_UPPER)
        out = []
        for m in TOKEN.finditer(text):
            bounded = (m.start() > 0 and text[m.start() - 1] != "*") or (m.start() == 0 and (self.is_host or self.pattern.startswith("||")))
            if bounded and m.end() < len(text) and text[m.end()] != "*":
                out.append(m[0])
        return out


#: The query's host rules, fixed by its contract.
HOST_RULES = (
    Rule("allow", "com/", True),
    Rule("block", "example.com/en/", True),
    Rule("allow", "www.example.com/en/", True),
    Rule("block", "net/es/", True),
    Rule("block", "net/fr/", True),
)
#: The query's list of pattern rules, a file that may be replaced by another.
RULE_FILE = os.path.join(os.path.dirname(__file__), "url_rules.txt")


def parse_rules(text: str) -> list[Rule]:
    """Pattern rules of a list: lines of ``block pattern``, ``allow pattern`` or ``words name word ...``.

    ``{name}`` in a pattern makes a rule for each word of that list, ``{one|two}``
    for those of both. Empty lines and those that begin with # say nothing, and a
    rule that repeats counts once. Other lines, and lists that aren't known, are errors.
    """
    words, rules = {}, {}
    for line in map(str.strip, text.splitlines()):
        kind, _, rest = line.partition(" ")
        if kind == "words":
            name, *words[name] = rest.split()
        elif kind in ("block", "allow") and rest.strip():
            parts = re.split(r"\{([^{}]+)\}", rest.strip())
            choices = [[w for name in x.split("|") for w in words[name]] if k % 2 else [x] for k, x in enumerate(parts)]
            rules.update(dict.fromkeys(Rule(kind, "".join(x)) for x in product(*choices)))
        elif line and not line.startswith("#"):
            raise ValueError(f"no rule: {line}")
    return list(rules)


def read_rules(path: str = RULE_FILE) -> list[Rule]:
    """Pattern rules of a list file, read by the driver."""
    with open(path, encoding="utf-8") as f:
        return parse_rules(f.read())


def rules_from(table: DataFrame, action: str = "action", pattern: str = "pattern", is_host: str | None = "is_host") -> list[Rule]:
    """Rules from a table with a row for each; rows that repeat count once, other columns aren't read, and an empty table has no rules. Rows with a null or empty pattern, or an action other than allow and block, are passed over; a null is_host is false. The list goes through the driver, as rules do anyway."""
    own = own_columns(table, {"action": action, "pattern": pattern, **({"is_host": is_host} if is_host else {})}).where("pattern <> '' AND action IN ('allow', 'block')")
    flag = F.coalesce(F.col("is_host"), F.lit(False)) if is_host else F.lit(False)
    return [Rule(r["action"], r["pattern"], r["host"]) for r in own.select("action", "pattern", flag.alias("host")).distinct().orderBy("action", "pattern", "host").collect()]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case; path: from there up to ? or #. Both empty without ://, or for a null url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class RuleIndex:
    """Rules by their rarest token; those without one are tried on every url. A rule is compiled when it is first tried."""

    def __init__(self, rules: Sequence[Rule], frequency: dict[str, int]):
        self.filed: dict[str, list[Rule]] = {}
        self.rest: list[Rule] = []
        self.compiled: dict[Rule, re.Pattern] = {}
        for rule in rules:
            tokens = rule.tokens()
            if tokens:
                self.filed.setdefault(min(tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(rule)
            else:
                self.rest.append(rule)

    def _fits(self, rule: Rule, text: str) -> bool:
        regex = self.compiled.get(rule)
        if regex is None:
            regex = self.compiled[rule] = re.compile(rule.regex, re.DOTALL)
        return regex.search(text) is not None

    def candidates(self, text: str) -> list[Rule]:
        """The rules that are to be tried on a url."""
        tried = list(self.rest)
        for token in set(TOKEN.findall(text.translate(_UPPER))):
            tried += self.filed.get(token, ())
        return tried

    def fitting(self, text: str) -> list[Rule]:
        return [rule for rule in self.candidates(text) if self._fits(rule, text)]


#: The index that this worker process has built last, by the number of its broadcast: tasks and batches share it.
_built: dict[str, RuleIndex] = {}


def _index(key: str, load) -> RuleIndex:
    if key not in _built:
        _built.clear()
        _built[key] = RuleIndex(*load())
    return _built[key]


def better(a: Rule | None, b: Rule | None) -> Rule | None:
    """Of two fitting rules the one that decides: host rules before patterns, longer host rules before shorter, then allow before block."""
    if a is None or b is None:
        return a or b
    rank = lambda r: (r.is_host, len(r.pattern) if r.is_host else 0, r.action == "allow", len(r.pattern), r.pattern)
    return max(a, b, key=rank)


_FOUND = pa.struct([("action", pa.string()), ("pattern", pa.string()), ("is_host", pa.bool_())])
FOUND_TYPE = "struct<action:string,pattern:string,is_host:boolean>"


def _judge(spark: SparkSession, rules: Sequence[Rule], frequency: dict[str, int]):
    shared, key = spark.sparkContext.broadcast((list(rules), frequency)), uuid.uuid4().hex

    def judge(texts: pa.Array, before: pa.Array) -> pa.Array:
        index, known, out = _index(key, lambda: shared.value), {}, []
        for text, so_far in zip(texts.to_pylist(), before.to_pylist(), strict=True):
            if text not in known:
                best = None
                for rule in index.fitting(text):
                    best = better(best, rule)
                known[text] = best
            best = better(known[text], Rule(**so_far) if so_far else None)
            out.append({"action": best.action, "pattern": best.pattern, "is_host": best.is_host} if best else None)
        return pa.array(out, _FOUND)

    return F.arrow_udf(judge, FOUND_TYPE)


def token_counts(texts: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many rows of the column ``text`` each of the tokens is. The result is as long as the list of tokens, not as the table."""
    if not tokens:
        return {}
    wanted = small(texts.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string"), BROADCAST_ROWS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TOKEN.pattern), F.lit(0)))).alias("token"))
    return {r["token"]: r["n"] for r in each.join(wanted, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = HOST_RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with four more columns: host, path, rule (of the host rule that decided, else null) and verdict (allow or block).

    Any of these that pages has already is replaced. Urls that are null, empty or
    lack :// have an empty host and path and get the default, unless a pattern
    fits the empty text; urls of any length are judged whole. Repeated rows stay,
    other columns too; an empty table gives an empty result. Rows don't move: the
    rules, indexed once in each worker, go to the urls. Lists longer than
    RULES_AT_ONCE take a pass for each such part over the distinct urls, whose
    best rule so far is written before the next part's index is built; the rows
    are joined with them at the end.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    text = F.concat(host, path)
    spark = pages.sparkSession
    frequency = token_counts(pages.select(text.alias("text")), {t for r in rules for t in r.tokens()})
    parts = [list(rules[a : a + RULES_AT_ONCE]) for a in range(0, len(rules), RULES_AT_ONCE)]
    judges = [_judge(spark, some, {t: frequency.get(t, 0) for r in some for t in r.tokens()}) for some in parts]
    none = F.lit(None).cast(FOUND_TYPE)
    if len(judges) > 1:
        best = pages.select(text.alias("text")).distinct().withColumn("best", none)
        for judge in judges:
            best = settled(best.select("text", judge("text", "best").alias("best")))
        own = pages.drop("rule")
        marked = own.select(F.struct("*").alias("page"), text.alias("text"))
        found = marked.join(small(best, BROADCAST_ROWS), "text", "left").select("page.*", F.col("best").alias("rule")).withColumns({"host": host, "path": path})
    else:
        found = pages.withColumns({"host": host, "path": path, "rule": judges[0](text, none) if judges else none})
    return found.withColumns({"rule": F.when(F.col("rule.is_host"), F.col("rule.pattern")), "verdict": F.coalesce("rule.action", F.lit(default))})


def _sql_like(rule: Rule) -> str:
    return "'" + rule.regex.replace("'", "''") + "'"


def sql(table: str = "pages", host_rules: Sequence[Rule] = HOST_RULES, patterns: Sequence[Rule] | None = None, default: str = "allow") -> str:
    """The query in DuckDB's SQL: every rule is tried on every url; patterns are those of the list file unless others are given."""
    patterns = read_rules() if patterns is None else patterns
    ranked = sorted(host_rules, key=lambda r: -len(r.pattern))
    rule = "CASE " + " ".join(f"WHEN regexp_matches(host || path, {_sql_like(r)}, 's') THEN '{r.pattern}'" for r in ranked) + " END"
    action = "CASE rule " + " ".join(f"WHEN '{r.pattern}' THEN '{r.action}'" for r in ranked) + " END"
    some = lambda kind: " OR ".join(f"regexp_matches(host || path, {_sql_like(r)}, 's')" for r in patterns if r.action == kind) or "false"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {table}),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM rest),
ruled AS (SELECT *, {rule} AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN {action}
  WHEN {some('allow')} THEN 'allow' WHEN {some('block')} THEN 'block' ELSE '{default}' END AS verdict
FROM ruled"""
