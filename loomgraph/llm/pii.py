"""Personal data: patterns propose spans, checksums confirm them, context words move their score.

DataFrame functions only. A null text counts as empty, an empty text has no
spans. Spans are (kind, start, end, score) in code points, end exclusive; for
each kind the leftmost matches that don't overlap. Rows that repeat an id are
all returned. Only the columns named are read, so extra columns do not matter.

Base kinds (always kept once their checks pass): email, ip, card, phone. Added
kinds need their check or their context: iban (mod-97) and tel, a number in
local form that words such as "phone" precede. An added span that overlaps a
base span is dropped.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "tel")

#: The contract's patterns in a form without backtracking: possessive runs, and no start inside a run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9][\x20-]?)[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "tel": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A character without which there is no match: most texts skip most patterns.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "tel": r"[0-9]{3}[\x20.-][0-9]{4}"}
#: Score without and with a context word in the CONTEXT characters before the span.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.7, 0.9), "iban": (0.8, 1.0), "tel": (0.3, 0.7)}
CONTEXT = 40
WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment",
    "phone": "tel|phone|call|mobile|fax",
    "iban": "iban|bank|account",
    "tel": "tel|phone|call|mobile|fax",
}
THRESHOLD = 0.5

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    s = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(s.substr(F.lit(5), F.length(s)), s.substr(1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(m))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _spans(text: Column, kind: str) -> Column:
    """Valid matches of a kind: what split leaves out between its parts is what regexp_extract_all finds."""
    rank = (BASE + ADDED).index(kind)
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def placed(found: Column, gaps: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(gaps, i))
            end = start + F.length(F.get(found, i))
            one = F.struct(start.alias("start"), end.alias("end"), F.get(found, i).alias("match"))
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

        zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda acc: acc["spans"])

    pair = F.struct(found.alias("m"), gaps.alias("g"))
    spans = F.get(
        F.transform(F.array(pair), lambda p: F.when(F.size(p["m"]) > 0, placed(p["m"], p["g"])).otherwise(empty)), F.lit(0)
    )
    low, high = SCORES[kind]

    def scored(s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = F.lower(text.substr(begin + 1, s["start"] - begin))
        score = F.when(before.rlike(rf"(?:^|[^a-z])(?:{WORDS[kind]})"), F.lit(high)).otherwise(F.lit(low))
        return F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score")
        )

    valid = F.transform(F.filter(spans, lambda s: _valid(kind, s["match"])), scored)
    return F.when(text.rlike(NEEDS[kind]), valid).otherwise(F.array().cast(f"array<{_SPAN}>"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (start, rank, end, kind, score) in order of start, then kind as listed."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    text = F.col("__text")
    df = df.select("id", "__text", *(_spans(text, k).alias(f"__{k}") for k in BASE + ADDED))
    df = df.withColumn("base", F.array_sort(F.concat(*(F.col(f"__{k}") for k in BASE))))
    clear = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter(F.concat(*(F.col(f"__{k}") for k in ADDED)), lambda s: (s["score"] >= THRESHOLD) & clear(s))
    return df.select("id", "base", F.when(F.size(added) > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): each span replaced by its kind in brackets; an overlapping later span is left to the first."""
    found = find_pii(docs, id_col, text_col)
    both = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t")).join(found, "id")

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.col("__t").substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        later = s["start"] >= acc["at"]
        return F.struct(F.when(later, s["end"]).otherwise(acc["at"]).alias("at"), F.when(later, new).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("spans", zero, step, lambda a: F.concat(a["out"], F.col("__t").substr(a["at"] + 1, F.length("__t"))))
    return both.select("id", done.alias("text"))


def query(docs: DataFrame) -> DataFrame:
    found = find_pii(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _duck_spans(kind: str, pattern: str, valid: str) -> str:
    rank = (BASE + ADDED).index(kind)
    low, high = SCORES[kind]
    at = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)"
    return f"""
      SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(v) AS stop,
             CASE WHEN regexp_matches(lower(substr(t, greatest(s - {CONTEXT}, 0) + 1, s - greatest(s - {CONTEXT}, 0))), '(^|[^a-z])({WORDS[kind]})')
                  THEN {high} ELSE {low} END AS score
      FROM (SELECT doc_id, t, m[i] AS v, ({at})::INT AS s
            FROM (SELECT doc_id, t, m, g, unnest(range(1, len(m) + 1)) AS i
                  FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM texts)))
      WHERE {valid}"""


def oracle_sql() -> str:
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"""(list_sum(list_transform(range(1, length({digits}) + 1), lambda k:
        CASE WHEN k % 2 = 0 THEN CASE WHEN substr(reverse({digits}), k, 1)::INT > 4 THEN substr(reverse({digits}), k, 1)::INT * 2 - 9
        ELSE substr(reverse({digits}), k, 1)::INT * 2 END ELSE substr(reverse({digits}), k, 1)::INT END)) % 10 = 0)"""
    turned = "(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4))"
    mod97 = f"""(list_reduce(list_prepend(0, list_transform(range(1, length({turned}) + 1), lambda k: ascii(substr({turned}, k, 1)))),
        lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1)"""
    octet = _OCTET.replace("(?:", "(")
    parts = [
        _duck_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        _duck_spans("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"regexp_full_match(v, '{octet}(\.{octet}){{3}}')"),
        _duck_spans("card", r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {luhn} ELSE false END"),
        _duck_spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
        _duck_spans("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", mod97),
        _duck_spans("tel", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", "(s = 0 OR NOT regexp_matches(substr(t, s, 1), '[0-9+]')) AND NOT regexp_matches(substr(t, s + length(v) + 1, 1), '[0-9]')"),
    ]
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({" UNION ALL ".join(parts)}),
    base AS (SELECT * FROM found WHERE rank < {len(BASE)}),
    every AS (SELECT * FROM base UNION ALL
              SELECT * FROM found f WHERE rank >= {len(BASE)} AND score >= {THRESHOLD} AND NOT EXISTS
                (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.start < f.stop AND f.start < b.stop)),
    b AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
          string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS j FROM base GROUP BY doc_id),
    e AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM every GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)},
           sha256(coalesce(j, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id"""
