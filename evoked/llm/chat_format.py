"""Chat formatting by schema fingerprints, in DataFrame operations only.

Records come in any layout, either as JSON texts or as structs, a column for each layout of which a row fills one. A record's
fingerprint is the hash of its nested field paths: the schema of the record with all leaf types taken out, so that a null
or a number in place of a text does not matter. The fingerprint picks a declarative mapping (``MAPPINGS``), which says where
turns are found and what their roles are. Fingerprints of structs come from the table's schema, and their texts are carried
as columns and never parsed. JSON records that the variant parser does not take, such as ones of many million characters,
are read again by a parser without limits, into maps from field to raw JSON, level by level as the mappings need.

Each turn is rendered as ``<turn ROLE>``, newline, text, ``</turn>``, newline. Within a text a backslash becomes ``\\e``
and the ``<`` of ``<turn`` or ``</turn`` becomes ``\\l``; within a role, ``>`` also becomes ``\\g``. So control strings
never stand in a text, the formatted conversation splits at them exactly, and unescaping gives each text back.

Turns are escaped and measured where they are read; only the last step gathers a conversation, which is one row.

Cases: null text or role: empty; texts of any length are kept whole, as long as a conversation fits a row of Spark (2^31
bytes); turns with equal numbers are ordered by role, then text; repeated rows are turns of their own; a null key is a
conversation of its own; records that are null or not JSON, or whose fingerprint no mapping has, give no turns and are found
by ``unmapped``; empty tables give no rows; extra fields in a record change its fingerprint and need a mapping of their own
(``mapping``), extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from evoked.llm.common import table

CLOSE = "</turn>\n"
TRAINED_ROLE = "assistant"


@dataclass(frozen=True)
class Mapping:
    """paths: the record's fields, ``[]`` for elements of arrays. turns: (role, path) of single texts, in order, where a
    role is given as a word; or one (path of role, path of text) below ``each``. first: the field with the first turn's number."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    each: str | None = None
    first: str | None = None


#: The layouts known from the start; ``mapping`` makes more.
MAPPINGS = (
    Mapping("turn", ("role", "text", "turn"), (("role", "text"),), each="", first="turn"),
    Mapping("messages", ("messages[].content", "messages[].role"), (("role", "content"),), each="messages"),
    Mapping("share", ("conversations[].from", "conversations[].value"), (("from", "value"),), each="conversations"),
    Mapping("prompt", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("input", "instruction", "output"), (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
)
#: Names that layouts have for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _skeleton(paths: tuple[str, ...]) -> str:
    """The schema text that records with these fields have, without leaf types."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path.split("."):
            at = at.setdefault(step, {})

    def text(t: dict) -> str:
        return "OBJECT<" + ", ".join(f"{k.removesuffix('[]')}: " + (f"ARRAY<{text(t[k])}>" if k.endswith("[]") and t[k] else "ARRAY<>" if k.endswith("[]") else text(t[k]) if t[k] else "") for k in sorted(t)) + ">"

    return text(tree)


def fingerprint(record: Column) -> Column:
    """The hash of a parsed record's field paths."""
    leaves = r"(VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|UUID|DECIMAL\(\d+,\d+\))(?=[,>]|$)"
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(record), leaves, ""))


def struct_skeleton(kind: DataType) -> str:
    """The same text for a struct type: its field paths without leaf types."""
    if isinstance(kind, StructType):
        return "OBJECT<" + ", ".join(f"{f.name}: {struct_skeleton(f.dataType)}" for f in sorted(kind.fields, key=lambda f: f.name)) + ">"
    return f"ARRAY<{struct_skeleton(kind.elementType)}>" if isinstance(kind, ArrayType) else ""


_TURNS = "array<struct<n:bigint,role:string,text:string>>"


def _turn_array(m: Mapping, field, items, whole) -> Column:
    """The turns that ``m`` finds. field(record, name): a text, or empty; items(name): SQL of an array of records; whole(name):
    a number."""
    if m.each is None:
        parts = ", ".join(f"struct({i}L AS n, '{role}' AS role, {field('rec', path)} AS text)" for i, (role, path) in enumerate(m.turns))
        return F.expr(f"CAST(array({parts}) AS {_TURNS})")
    (role, path), first = m.turns[0], f"coalesce({whole(m.first)}, 0L)" if m.first else "0L"
    if not m.each:
        return F.expr(f"CAST(array(struct({first} AS n, {field('rec', role)} AS role, {field('rec', path)} AS text)) AS {_TURNS})")
    return F.expr(f"CAST(transform({items(m.each)}, (x, i) -> struct({first} + i AS n, {field('x', role)} AS role, {field('x', path)} AS text)) AS {_TURNS})")


def _variant_turns(m: Mapping) -> Column:
    return _turn_array(
        m, lambda r, p: f"coalesce(try_variant_get({r}, '$.{p}', 'string'), '')",
        lambda p: f"CAST(try_variant_get(rec, '$.{p}', 'array<variant>') AS array<variant>)", lambda p: f"try_variant_get(rec, '$.{p}', 'bigint')",
    )


def _struct_turns(m: Mapping) -> Column:
    return _turn_array(m, lambda r, p: f"coalesce(CAST({r}.`{p}` AS string), '')", lambda p: f"rec.`{p}`", lambda p: f"CAST(rec.`{p}` AS bigint)")


def _map_turns(m: Mapping) -> Column:
    return _turn_array(
        m, lambda r, p: f"coalesce({r}['{p}'], '')", lambda p: f"from_json(rec['{p}'], 'array<map<string,string>>', map('maxStringLen', '{_NO_LIMIT}'))",
        lambda p: f"TRY_CAST(rec['{p}'] AS bigint)",
    )


_NO_LIMIT = 2**31 - 1


def _map_fits(m: Mapping) -> Column:
    """Whether a record read into a map has the field paths of ``m``: those of the record and, below ``each``, of its elements."""
    def same(fields: str, paths) -> str:
        return f"array_sort({fields}) = array_sort(array({', '.join(repr(p) for p in paths)}))"

    top = sorted({p.split(".")[0].removesuffix("[]") for p in m.paths})
    fits = same("map_keys(rec)", top)
    if m.each:
        below = [p.split(".", 1)[1] for p in m.paths if p.startswith(f"{m.each}[].")]
        items = f"from_json(rec['{m.each}'], 'array<map<string,string>>', map('maxStringLen', '{_NO_LIMIT}'))"
        fits += f" AND coalesce(forall({items}, x -> {same('map_keys(x)', below)}), false)"
    return F.expr(fits)


def _chosen(mappings, fits, turns) -> Column:
    chosen = F.when(F.lit(False), F.lit(None).cast(_TURNS))
    for m in mappings:
        chosen = chosen.when(fits(m), turns(m))
    return chosen


def _canonical(rows: DataFrame, key: str) -> DataFrame:
    turns = rows.select(key, F.explode("turns").alias("t")).select(key, F.col("t.n").alias("n"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return turns.withColumn("role", F.coalesce(F.try_element_at(names, F.col("role")), F.col("role")))


def canonical_turns(records: DataFrame, key: str = "conv_id", record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """(key, n, role, text): the turns of all JSON records that a mapping fits."""
    rows = records.select(key, F.try_parse_json(record).alias("rec"), F.col(record).alias("json"))
    parsed = rows.where("rec IS NOT NULL").withColumn("print", fingerprint(F.col("rec")))
    parsed = parsed.select(key, _chosen(mappings, lambda m: F.col("print") == F.xxhash64(F.lit(_skeleton(m.paths))), _variant_turns).alias("turns"))
    left = rows.where("rec IS NULL AND json IS NOT NULL").select(key, F.expr(f"from_json(json, 'map<string,string>', map('maxStringLen', '{_NO_LIMIT}'))").alias("rec"))
    left = left.where("rec IS NOT NULL").select(key, _chosen(mappings, _map_fits, _map_turns).alias("turns"))
    return _canonical(parsed.unionByName(left), key)


def struct_turns(records: DataFrame, key: str = "conv_id", mappings=MAPPINGS) -> DataFrame:
    """(key, n, role, text): the turns of all records in the struct columns of ``records``. A column's fingerprint picks its
    mapping; columns without one are left out (``unmapped_structs``)."""
    known, out = {_skeleton(m.paths): m for m in mappings}, None
    for f in records.schema.fields:
        m = known.get(struct_skeleton(f.dataType)) if isinstance(f.dataType, StructType) else None
        if m:
            part = _canonical(records.where(F.col(f"`{f.name}`").isNotNull()).select(key, F.col(f"`{f.name}`").alias("rec")).select(key, _struct_turns(m).alias("turns")), key)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no struct column has the layout of a mapping")
    return out


def unmapped_structs(records: DataFrame, mappings=MAPPINGS) -> dict[str, str]:
    """Struct columns that no mapping fits, with their field paths."""
    known = {_skeleton(m.paths) for m in mappings}
    return {f.name: s for f in records.schema.fields if isinstance(f.dataType, StructType) and (s := struct_skeleton(f.dataType)) not in known}


def unmapped(records: DataFrame, record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """(fingerprint, schema, n) of the records that no mapping fits."""
    rec = F.try_parse_json(record)
    known = [F.xxhash64(F.lit(_skeleton(m.paths))) for m in mappings]
    seen = records.select(fingerprint(rec).alias("fingerprint"), F.schema_of_variant(rec).alias("schema"))
    return seen.where(F.col("fingerprint").isNull() | ~F.col("fingerprint").isin(*known)).groupBy("fingerprint").agg(F.min("schema").alias("schema"), F.count("*").alias("n"))


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\e"), ("<turn", "\\lturn"), ("</turn", "\\l/turn")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("\\g", ">"), ("\\l", "<"), ("\\e", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def render(turns: DataFrame, key: str = "conv_id", trained: str = TRAINED_ROLE) -> DataFrame:
    """(key, formatted, segments): the conversation, and for each turn the code points (start, end) of its text in it
    and whether the loss is on it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("<turn "), F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit(">\n"))
    parts = turns.select(key, "n", role.alias("role"), head.alias("head"), escape(text).alias("body"))
    parts = parts.withColumn("len", (F.length("head") + F.length("body") + len(CLOSE)).cast("long"))
    order = ["n", "role", "body"]
    so_far = F.sum("len").over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    start = so_far - F.col("len") + F.length("head")
    parts = parts.select(key, F.struct(*order, start.alias("start"), "head").alias("t"))
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return rows.select(
        key, F.array_join(F.transform("ts", lambda t: F.concat(t.head, t.body, F.lit(CLOSE))), "").alias("formatted"),
        F.transform("ts", lambda t: F.struct(t.start.alias("start"), (t.start + F.length(t.body)).alias("end"), (t.role == trained).alias("loss"))).alias("segments"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, ">\n", 1), 7, 2**31 - 1)).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, ">\n", 1)) + 3, F.length(p))).alias("text"),
    ))


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    same = F.lit(r"\### Assistant: </turn> ok")
    turns = rows.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), "role", "text").alias("as_turn"))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.struct(same.alias("prompt"), same.alias("completion")).alias("as_prompt"))
    out = render(struct_turns(turns.unionByName(extra, allowMissingColumns=True)))
    out = out.select("conv_id", "formatted", "segments", read_back(F.col("formatted")).alias("turns"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter(F.arrays_zip("turns", "segments"), lambda z: z.segments.loss), lambda z: z.turns.text), "")
    out = out.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), flat.alias("flat"), loss.alias("loss"))
    return out.select(
        "conv_id", "n_turns", F.sha2("flat", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '<turn', ''))) // 5
             + (length(text) - length(replace(text, '</turn', ''))) // 6 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + length(role) + 16) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
