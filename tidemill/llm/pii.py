"""Personal data in texts, with DataFrame functions alone.

Patterns propose spans; checksums and ranges confirm them (Luhn for cards,
mod-97 for bank accounts, parts of addresses up to 255); words nearby raise or
lower a span's score. A text's matches come from regexp_extract_all and what
lies between them from split by the same pattern, whose lengths give positions.

The patterns are possessive, so that runs of any length take linear time and no
recursion (positions are then added up over runs of RUN matches, at a cost that
grows with the square of the number of runs), and match what the greedy ones of the contract match: nothing after
a possessive part can use what it would give back. ``(?:\\G|(?<!x))`` starts a
match where a run starts or where the last match ended, as later starts within
a run can't match if the first doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.work import own_columns

BASE = ("email", "ip", "card", "phone")
#: What the method adds.
ADDED = ("iban", "ssn")
KINDS = (*BASE, *ADDED)

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9_])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must have for a pattern to be tried at all.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "ssn": lambda t: t.rlike(r"-[0-9]{2}-"),
}
#: Score of a confirmed span alone, and words that add to it or take from it within NEAR characters, up to the next match of the kind.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
NEAR, ADJUST = 40, 0.3
RUN = 128
SPAN = "struct<kind:string,start:int,end:int,score:double>"
#: Words of English, German, French and Spanish.
FOR = {
    "email": "e-?mail|mail|contact|write|mailto|kontakt|schreib|courriel|contacter|correo|escribe",
    "ip": "ip|host|server|address|login|adresse|serveur|servidor",
    "card": "card|visa|mastercard|credit|debit|payment|karte|kreditkarte|zahlung|carte|paiement|tarjeta|pago",
    "phone": "phone|tel|call|mobile|fax|whatsapp|telefon|handy|anruf|appel|portable|llame|llamar|celular",
    "iban": "iban|bank|account|transfer|swift|bic|konto|virement|compte|banque|banco|cuenta",
    "ssn": "ssn|social|security|taxpayer",
}
AGAINST = {
    "email": "example|test|beispiel|exemple|ejemplo",
    "ip": "version|release|section|chapter|kapitel|chapitre",
    "card": "order|invoice|isbn|serial|tracking|rechnung|bestellung|facture|commande|factura|pedido",
    "phone": "isbn|order|serial|version|bestellung|commande|pedido",
    "iban": "serial|model|part|modell|modelo",
    "ssn": "isbn|part|order|model",
}


def near_pattern(words: str) -> str:
    """The words standing alone in lower-case text, as any engine's patterns say it."""
    return f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"


#: Added spans below this score are left out; base spans always stay.
LEAST_SCORE = 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return (total + d - F.when(d > 9, 9).otherwise(0)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    compact = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97).cast("int")

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(add(rest, c)).cast("int")) == 1


def confirmed(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(match, r"\."), lambda part: F.coalesce(part.try_cast("bigint"), F.lit(256)) <= 255),
        "card": F.when(n.between(16, 19), luhn(_digits(match))).otherwise(False),
        "phone": n.between(8, 15),
        "iban": mod97(match),
        "ssn": ~match.rlike("^(?:000|666|9)|-00-|-0000$"),
    }[kind]


def _matches(kind: str, text: Column) -> Column:
    """Matches of the kind's pattern; none for texts that lack what it needs."""
    tried = F.when(NEEDS[kind](text), text).otherwise("")
    return F.regexp_extract_all(tried, F.lit(PATTERNS[kind]), F.lit(0))


def _gaps(kind: str, text: Column) -> Column:
    return F.split(F.when(NEEDS[kind](text), text).otherwise(""), PATTERNS[kind], -1)


def _runs(matches: Column, gaps: Column) -> Column:
    """Matches in runs of RUN at most, each with its length, that of the gap before it, and the text around it within the gaps."""
    n = F.size(matches)

    def one(m: Column, i: Column) -> Column:
        before, after = F.get(gaps, i), F.get(gaps, i + 1)
        return F.struct(F.length(before).alias("gap"), F.length(m).alias("length"), m.alias("match"), F.lower(F.concat_ws(" ", F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR)))).alias("near"))

    def run(r: Column) -> Column:
        return F.transform(F.sequence(r * RUN, F.least(n, (r + 1) * RUN) - 1), lambda i: one(F.get(matches, i), i))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.ceil(n / RUN).cast("int") - 1), run))


def _lengths(runs: Column) -> Column:
    return F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda n, x: n + x["gap"] + x["length"]))


def _starts(lengths: Column) -> Column:
    return F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda n, x: n + x))


def _spans(kind: str, runs: Column, starts: Column) -> Column:
    """The kind's confirmed spans with their scores. Positions add up over whole runs, then within each, so that long lists take little more than linear time."""
    nothing = F.array().cast(f"array<{SPAN}>")

    def score(near: Column) -> Column:
        raw = F.lit(SCORES[kind]) + F.when(near.rlike(near_pattern(FOR[kind])), ADJUST).otherwise(0.0) - F.when(near.rlike(near_pattern(AGAINST[kind])), ADJUST).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(raw, 2)))

    def placed(run: Column, at: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["length"]
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.when(confirmed(kind, x["match"]), score(x["near"])).alias("score"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(run, F.struct(at.alias("at"), nothing.alias("out")), add, lambda acc: acc["out"])

    least = LEAST_SCORE if kind in ADDED else 0.0
    return F.coalesce(F.filter(F.flatten(F.zip_with(runs, starts, placed)), lambda s: s["score"] >= least), nothing)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, spans), spans being structs of kind, start, end and score by kind as in KINDS, then start.

    Positions are code points, the end exclusive; matches of a kind don't
    overlap, those of different kinds may. Null and empty texts have no spans.
    Texts of any length are searched whole. Repeated rows and null ids stay as
    they are, other columns are not read, an empty table gives an empty result.
    Each row depends on its own text alone: one pass, no shuffle, no Python.
    """
    given = own_columns(docs, {"id": id_col, "text": text_col}).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    for step in (  # one select each, so that Spark computes each array once
        {f"{k}_{what}": f(k, text) for k in KINDS for what, f in (("matches", _matches), ("gaps", _gaps))},
        {f"{k}_runs": _runs(F.col(f"{k}_matches"), F.col(f"{k}_gaps")) for k in KINDS},
        {f"{k}_lengths": _lengths(F.col(f"{k}_runs")) for k in KINDS},
        {f"{k}_starts": _starts(F.col(f"{k}_lengths")) for k in KINDS},
        {k: _spans(k, F.col(f"{k}_runs"), F.col(f"{k}_starts")) for k in KINDS},
    ):
        given = given.withColumns(step)
    return given.select(F.col("id").alias(id_col), F.concat(*KINDS).alias("spans"))


#: The patterns as RE2 has them: plain, as the contract gives them, and for the added kinds with word boundaries or whole runs.
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b",
    "ssn": r"[0-9-]+",
}
_SQL_DIGITS = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_SQL_LUHN = f"list_sum(list_transform(string_split(reverse({_SQL_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE c::INT * 2 - CASE WHEN c::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_SQL_TURNED = "list_transform(string_split(substr(replace(x.m, ' ', ''), 5) || substr(replace(x.m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END)"
_SQL_CONFIRMED = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(x.m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND ('0' || right(p, 3))::INT <= 255))",
    "card": f"CASE WHEN length({_SQL_DIGITS}) BETWEEN 16 AND 19 THEN {_SQL_LUHN} ELSE false END",
    "phone": f"length({_SQL_DIGITS}) BETWEEN 8 AND 15",
    "iban": f"list_reduce(list_transform(string_split(array_to_string({_SQL_TURNED}, ''), ''), lambda c: c::INT), lambda a, b: (a * 10 + b) % 97) = 1",
    "ssn": "regexp_full_match(x.m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(x.m, '^(?:000|666|9)|-00-|-0000$')"
    f" AND regexp_matches(x.near, '{near_pattern(FOR['ssn'])}') AND NOT regexp_matches(x.near, '{near_pattern(AGAINST['ssn'])}')",
}


def sql() -> str:
    """The query in DuckDB's SQL. The context of a social security number ends at the next run of digits there, which only matters where such runs are close."""
    found = ", ".join(f"regexp_extract_all(t, '{p}') AS m_{k}, string_split_regex(t, '{p}') AS g_{k}" for k, p in _SQL_PATTERNS.items())

    def placed(k: str) -> str:
        before = f"list_sum(list_transform(g_{k}[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m_{k}[1:i-1], lambda m: length(m))), 0)"
        near = f"lower(right(g_{k}[i], {NEAR}) || ' ' || left(g_{k}[i+1], {NEAR}))"
        return f"list_transform(range(1, len(m_{k}) + 1), lambda i: {{'m': m_{k}[i], 'a': ({before})::BIGINT, 'near': {near}}}) AS p_{k}"

    def told(k: str) -> str:
        return f"list_transform(list_filter(p_{k}, lambda x: {_SQL_CONFIRMED[k]}), lambda x: '{k}:' || x.a || ':' || (x.a + length(x.m))) AS s_{k}"

    def score(k: str) -> str:
        told = lambda words, sign: f"CASE WHEN regexp_matches(x.near, '{near_pattern(words[k])}') THEN {sign}{round(100 * ADJUST)} ELSE 0 END"
        return f"list_transform(list_filter(p_{k}, lambda x: {_SQL_CONFIRMED[k]}), lambda x: greatest(0, least(100, {round(100 * SCORES[k])} + {told(FOR, '')} + {told(AGAINST, '-')}))::VARCHAR) AS c_{k}"

    def joined(kinds: tuple[str, ...]) -> str:
        return "array_to_string(" + " || ".join(f"s_{k}" for k in kinds) + ", ',')"

    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, {found} FROM texts),
placed AS (SELECT doc_id, {', '.join(map(placed, KINDS))} FROM found),
told AS (SELECT doc_id, {', '.join(map(told, KINDS))}, {', '.join(map(score, KINDS))} FROM placed)
SELECT doc_id, {', '.join(f'len(s_{k})::BIGINT AS n_{k}' for k in BASE)}, sha256({joined(BASE)}) AS base_sha256, {joined(KINDS)} AS spans,
  array_to_string({' || '.join(f'c_{k}' for k in KINDS)}, ',') AS scores FROM told"""
