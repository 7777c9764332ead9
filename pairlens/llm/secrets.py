"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans are what three patterns match, leftmost and non-overlapping per kind:
``assign`` (a keyword, a separator and a value of 12 or more characters),
``access`` (an access identifier of 18 or more) and ``hex`` (16 or more). They
always stay. Weak parts are identifiers (``ident``), long tokens of letters and
digits (``key``) and addresses (``endpoint``): common on their own, so that they
are reported only when complementary parts lie in the same scope, less than SCOPE
characters away: an identifier with a secret; a key with an identifier or an
endpoint; an endpoint with both an identifier and a secret. Weak parts that
overlap a base span aren't reported again.

Positions are code points. They come from the lengths of matches and of what lies
between, summed by a window over each document's matches, so that the number of
matches in a text doesn't matter. The interval join meets in bins of SCOPE
characters, which hold a bounded number of parts each.

Null texts count as empty: no spans. Rows are known by id and text hash, so that
repeated rows and null ids get their own text's spans. Texts of any length are
read whole; an empty table gives no rows. Columns other than the named ones aren't
read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._support import fresh, staged

SCOPE = 200
BLOCK = 4096
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
BASE = 3
#: Fixed values. Runs of a class are matched whole, so that a lower bound on the run drops what a later check of its length would.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "ident": r"""(?i)(?:access_?key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "key": r"[A-Za-z0-9+/_-]{32,}={0,2}",
    "endpoint": r"""(?i)(?:https?|s3|jdbc:[a-z0-9]+|amqps?|redis|mongodb|postgres(?:ql)?|mysql|ftp)://[^\x00-\x20"'<>]+""",
}
ASSIGN_VALUE = 12
_ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "key": "secret", "endpoint": "endpoint"}


def _matches(text: Column, rank: int) -> Column:
    """array<struct<kind, pos, gap, len, ok>> of a kind's matches; empty, after one look, where there is none."""
    kind, pattern = KINDS[rank], F.lit(PATTERNS[KINDS[rank]])
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.char_length)
    zipped = F.arrays_zip(whole.alias("whole"), gaps.alias("gap"))
    ok = {"assign": lambda v: F.char_length(F.regexp_extract(v, PATTERNS[kind], 2)) >= ASSIGN_VALUE, "key": lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")}.get(kind, lambda v: F.lit(True))
    found = F.transform(zipped, lambda z, i: F.struct(F.lit(rank).alias("kind"), i.alias("pos"), z["gap"].alias("gap"), F.char_length(z["whole"]).alias("len"), ok(z["whole"]).alias("ok")))
    found = F.filter(found, lambda z: z["len"].isNotNull())
    return F.when(text.rlike(PATTERNS[kind]), found).otherwise(F.array().cast(_ARRAY))


_ARRAY = "array<struct<kind:int,pos:int,gap:int,len:int,ok:boolean>>"
ROW = ["doc_id", "h"]


def _keyed(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def parts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, h, kind (its place in KINDS), start, end of every match, weak ones too."""
    found = _keyed(df, text_col, id_col).select(*ROW, *(_matches(F.col("text"), rank).alias(kind) for rank, kind in enumerate(KINDS)))
    rows = found.select(*ROW, F.explode(F.flatten(F.array(*KINDS))).alias("m")).select(*ROW, "m.*")
    # repeated rows go before the shuffle, within their partitions
    once = rows.dropDuplicates([*ROW, "kind", "pos"])
    before = Window.partitionBy(*ROW, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(before)
    return once.withColumn("end", end).filter("ok").select(*ROW, "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that complementary parts in scope make credible: an interval join in bins."""
    role = F.element_at(F.array(*(F.lit(_ROLES[k]) for k in KINDS)), F.col("kind") + 1)
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope))).alias("bin")
    weak = found.filter(F.col("kind") >= BASE).select(*ROW, "kind", "start", "end", bins(F.col("start") - scope, F.col("end") - 1 + scope))
    other = found.select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"), role.alias("role"), (F.col("kind") < BASE).alias("base"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), bins(F.col("start"), F.col("end") - 1).alias("r_bin"))
    near = (F.col("r_start") < F.col("end") + scope) & (F.col("r_end") > F.col("start") - scope)
    pairs = weak.join(other, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h")) & (F.col("bin") == F.col("r_bin")) & near)
    has = lambda name: F.bool_or(F.col("role") == name).alias(name)
    covered = F.bool_or(F.col("base") & (F.col("r_start") < F.col("end")) & (F.col("r_end") > F.col("start"))).alias("covered")
    seen = pairs.groupBy(*ROW, "kind", "start", "end").agg(has("identifier"), has("secret"), has("endpoint"), covered)
    ident, key, endpoint = (KINDS.index(k) for k in ("ident", "key", "endpoint"))
    credible = (
        F.when(F.col("kind") == ident, F.col("secret"))
        .when(F.col("kind") == key, F.col("identifier") | F.col("endpoint"))
        .when(F.col("kind") == endpoint, F.col("identifier") & F.col("secret"))
    )
    return seen.filter(credible & ~F.col("covered")).select(*ROW, "kind", "start", "end")


def spans(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """doc_id, h, spans: array<struct<start, kind, end>> in order, of the rows with any."""
    found = staged(parts(df, text_col, id_col), "parts")
    kept = found.filter(F.col("kind") < BASE).unionByName(linked(found, scope))
    return kept.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def _with_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows keyed by doc_id and h with their spans, an empty array where there is none."""
    right = found.select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"), "spans")
    joined = rows.join(right, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h")), "left")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))).drop("r_id", "r_h")


def redacted(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", mask: str = "[REDACTED]") -> DataFrame:
    """The same columns and rows; each text with spans has them masked, overlapping ones together. Null texts stay null."""
    found = spans(df, text_col, id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key, h, kept = (fresh(df, c) for c in ("id_", "h_", "spans_"))
    right = found.select(F.col("doc_id").alias(key), F.col("h").alias(h), F.col("spans").alias(kept))
    joined = df.join(right, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(h)), "left")
    # positions are sought within blocks, so that the work doesn't grow with the product of spans and length
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    cut = lambda block, low, begin, end: F.substring(block, (begin - low + 1).cast("int"), (end - begin).cast("int"))

    def masked(block: Column, number: Column) -> Column:
        low = number.cast("long") * BLOCK
        high = low + F.char_length(block)
        step = lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], cut(block, low, acc["at"], s["start"]), F.lit(mask))).otherwise(acc["out"]).alias("out"),
            F.least(F.greatest(acc["at"], s["end"]), high).alias("at"),
        )
        here = F.filter(kept, lambda s: (s["start"] < high) & (s["end"] > low))
        return F.aggregate(here, F.struct(F.lit("").alias("out"), low.alias("at")), step, lambda acc: F.concat(acc["out"], cut(block, low, acc["at"], high)))

    whole = F.array_join(F.transform(blocks, masked), "")
    return joined.withColumn(text_col, F.when(F.col(kept).isNull(), F.col(text_col)).otherwise(whole)).select(*df.columns)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans and the linked ones."""
    from ._support import table

    docs = table(spark, sf_dir, "documents")
    rows = _with_spans(_keyed(docs, "text", "doc_id").drop("text"), spans(docs))
    names = F.array(*(F.lit(k) for k in KINDS))
    listed = lambda part: F.array_join(F.transform(part, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda rank: F.size(F.filter("spans", lambda s: s["kind"] == rank)).cast("long")
    return rows.select(
        "doc_id",
        *(count(rank).alias(f"n_{KINDS[rank]}") for rank in range(BASE)),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < BASE)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    kinds = "\nunion all\n".join(
        f"select doc_id, h, {rank} as kind, unnest(range(1, len(m) + 1)) as pos, unnest(m) as whole, unnest(v) as value, unnest(gaps[1:len(m)]) as gap from "
        f"(select doc_id, h, regexp_extract_all(t, '{quoted[k]}', 0) as m, regexp_extract_all(t, '{quoted[k]}', {2 if k == 'assign' else 0}) as v, "
        f"list_transform(string_split_regex(t, '{quoted[k]}'), lambda x: length(x)) as gaps from d) where len(m) > 0"
        for rank, k in enumerate(KINDS)
    )
    roles = " ".join(f"when {rank} then '{_ROLES[k]}'" for rank, k in enumerate(KINDS))
    names = ", ".join(f"'{k}'" for k in KINDS)
    listed = lambda cond: f"coalesce(string_agg([{names}][kind + 1] || ':' || \"start\" || ':' || \"end\", ',' order by \"start\", kind, \"end\") filter (where {cond}), '')"
    return f"""
with d as (select distinct doc_id, coalesce(text, '') as t, hash(coalesce(text, '')) as h from documents),
m as ({kinds}),
p as (select *, sum(gap + length(whole)) over (partition by doc_id, h, kind order by pos) as "end" from m),
s as (select doc_id, h, kind, "end" - length(whole) as "start", "end" from p
  where (kind <> 0 or length(value) >= {ASSIGN_VALUE}) and (kind <> 4 or regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]'))),
r as (select *, case kind {roles} end as role from s),
w as (select a.doc_id, a.h, a.kind, a."start", a."end", bool_or(b.role = 'identifier') as i, bool_or(b.role = 'secret') as c, bool_or(b.role = 'endpoint') as e,
  bool_or(b.kind < {BASE} and b."start" < a."end" and b."end" > a."start") as covered
  from s a join r b on a.doc_id is not distinct from b.doc_id and a.h = b.h and b."start" < a."end" + {SCOPE} and b."end" > a."start" - {SCOPE}
  where a.kind >= {BASE} group by all),
k as (select doc_id, h, kind, "start", "end" from s where kind < {BASE} union all
  select doc_id, h, kind, "start", "end" from w where not covered and case kind when 3 then c when 4 then i or e else i and c end),
g as (select doc_id, h, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex,
  {listed(f"kind < {BASE}")} as base, {listed("true")} as spans from k group by doc_id, h)
select x.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents x left join g on x.doc_id is not distinct from g.doc_id and hash(coalesce(x.text, '')) = g.h
"""


ORACLE_SQL = {"op9_secrets": _oracle()}
