r"""Chat formatting by schema fingerprints.

Method: the nested field paths of a layout (``messages[].role`` and so on) are hashed into
a fingerprint, which selects a declarative mapping to canonical turns. Tables are
fingerprinted by their schema; JSON records one by one: the known paths that a record has are
hashed in the plan and looked up in the table of the mappings' fingerprints. The
turns of a conversation become one string:

    <|turn|>ROLE<|text|>TEXT<|end|>  (for each turn, in order)

Control strings inside roles and texts are escaped reversibly: backslashes are doubled,
then one backslash goes behind the first character of every control string. After
doubling, backslash runs have even length, so a single one can't be mistaken.

Only DataFrame operations: one shuffle by conversation serves the running offsets and
the grouping.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a text must not hold unescaped: the template's, and other common ones.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in CONTROL:
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


# ---- schema fingerprints -------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths it needs and how they become turns.

    ``rows``: one row a turn, columns in the order conversation, turn, role, text.
    ``list``: (array path, role field, text field). ``fields``: (path, role) pairs, one
    turn for each that isn't empty.
    """

    name: str
    paths: tuple[str, ...]
    kind: str
    spec: tuple


MAPPINGS: tuple[Mapping, ...] = (
    Mapping("turn_rows", ("conv_id", "turn", "role", "text"), "rows", ("conv_id", "turn", "role", "text")),
    Mapping("messages", ("messages[].role", "messages[].content"), "list", ("messages", "role", "content")),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), "list", ("conversations", "from", "value")),
    Mapping("instruction_input", ("instruction", "input", "output"), "fields", (("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping("instruction", ("instruction", "output"), "fields", (("instruction", "user"), ("output", "assistant"))),
    Mapping("system_prompt_response", ("system", "prompt", "response"), "fields", (("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("prompt_response", ("prompt", "response"), "fields", (("prompt", "user"), ("response", "assistant"))),
    Mapping("prompt_completion", ("prompt", "completion"), "fields", (("prompt", "user"), ("completion", "assistant"))),
    Mapping("question_answer", ("question", "answer"), "fields", (("question", "user"), ("answer", "assistant"))),
)
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """The nested leaf paths of a schema; array elements are written ``[]``."""
    out: list[str] = []
    for f in schema.fields:
        path, kind = prefix + f.name, f.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        out += field_paths(kind, path + ".") if isinstance(kind, T.StructType) else [path]
    return out


def fingerprint(paths: Sequence[str]) -> str:
    """The hash of a set of paths; ``_fingerprint`` is the same as a column."""
    return sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _fingerprint(paths: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(paths), "\n"), 256), 1, 16)


def mapping_for(schema: T.StructType, mappings: Sequence[Mapping] = MAPPINGS) -> Mapping:
    """The mapping whose fingerprint the schema's known paths have.

    Unknown columns don't count. If several layouts' paths are present at once, the
    one that explains most paths wins, then the first.
    """
    known = {p for m in mappings for p in m.paths}
    have = set(field_paths(schema))
    exact = {fingerprint(m.paths): m for m in reversed(mappings)}.get(fingerprint(sorted(have & known)))
    if exact:
        return exact
    fit = [m for m in mappings if set(m.paths) <= have]
    if not fit:
        raise ValueError(f"no mapping for the paths {sorted(have)}")
    return max(fit, key=lambda m: len(m.paths))


def _role(col: Column) -> Column:
    out = F.coalesce(col, F.lit(""))
    for a, b in ROLES.items():
        out = F.when(out == a, F.lit(b)).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _list_turns(items: Column, role: str, text: str) -> Column:
    return F.transform(items, lambda t: _turn(_role(t[role]), t[text]))


def canonical_turns(df: DataFrame, conv_id: str = "conv_id", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """``conv_id, turn, role, text`` from any known layout; null roles and texts are empty.

    Rows of turns keep their roles; in the other layouts ROLES renames some.

    Defined cases: a null list has no turn; an empty prompt, instruction or answer is no turn; repeated
    records repeat their turns (equal numbers, in the order that formatting gives ties);
    ids, null ones too, are passed on; extra columns are ignored unless they make up
    another layout; an empty table gives none; a table that fits no layout is an error.
    """
    m = mapping_for(df.schema, mappings)
    if m.kind == "rows":
        c, t, r, x = m.spec
        return df.select(F.col(c).alias("conv_id"), F.col(t).cast("long").alias("turn"), F.coalesce(F.col(r), F.lit("")).alias("role"), F.coalesce(F.col(x), F.lit("")).alias("text"))
    if m.kind == "list":
        path, role, text = m.spec
        turns = _list_turns(F.col(path), role, text)
    else:
        turns = F.filter(F.array(*[_turn(F.lit(role), F.col(p)) for p, role in m.spec]), lambda t: t["text"] != "")
    return df.select(F.col(conv_id).alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def _has(path: str) -> Column:
    """Whether the variant ``v`` has a path; of a list, whether any element has the field."""
    head, _, field = path.partition("[].")
    if not field:
        return F.try_variant_get(F.col("v"), f"$.{path}", "variant").isNotNull()
    items = F.try_variant_get(F.col("v"), f"$.{head}", "array<variant>")
    return F.coalesce(F.exists(items, lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull()), F.lit(False))


def canonical_json(df: DataFrame, json_col: str = "json", conv_id: str = "conv_id", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """``conv_id, layout, schema_hash, turn, role, text`` from JSON records of mixed layouts.

    ``schema_hash`` is the fingerprint of the record's known paths; the mapping of that
    fingerprint is the record's layout. A record that has the paths of several layouts at
    once has a fingerprint of its own: of the layouts whose paths it has, the one with most
    is taken, then the first.

    Defined cases: records that are null, don't parse or fit no layout have layout null, no
    turn and null role and text, and stay visible that way; so does an empty list. Null roles and
    texts are empty. Repeated records repeat their turns; extra fields and columns are
    ignored; an empty table gives none.
    """
    usable = [m for m in mappings if m.kind != "rows"]
    known = sorted({p for m in usable for p in m.paths})
    d = df.select(F.col(conv_id).alias("conv_id"), F.try_parse_json(F.col(json_col)).alias("v"))
    have = F.array_compact(F.array(*[F.when(_has(p), F.lit(p)) for p in known]))
    d = d.select("conv_id", "v", have.alias("paths")).withColumn("schema_hash", F.when(F.col("v").isNotNull(), _fingerprint(F.col("paths"))))
    table = F.create_map(*[F.lit(x) for m in reversed(usable) for x in (fingerprint(m.paths), m.name)]) if len({fingerprint(m.paths) for m in usable}) == len(usable) else None
    if table is None:
        raise ValueError("two mappings have the same paths")
    several = F.lit(None).cast("string")
    for m in sorted(reversed(usable), key=lambda m: len(m.paths)):
        several = F.when(F.forall(F.array(*[F.lit(p) for p in m.paths]), lambda p: F.array_contains(F.col("paths"), p)), F.lit(m.name)).otherwise(several)
    d = d.withColumn("layout", F.coalesce(F.try_element_at(table, F.col("schema_hash")), several))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in usable:
        if m.kind == "list":
            path, role, text = m.spec
            own = _list_turns(F.try_variant_get(F.col("v"), f"$.{path}", f"array<struct<`{role}`:string,`{text}`:string>>"), role, text)
        else:
            own = F.filter(F.array(*[_turn(F.lit(role), F.try_variant_get(F.col("v"), f"$.{p}", "string")) for p, role in m.spec]), lambda t: t["text"] != "")
        turns = F.when(F.col("layout") == m.name, own).otherwise(turns)
    d = d.select("conv_id", "layout", "schema_hash", F.posexplode_outer(turns).alias("turn", "t"))
    return d.select("conv_id", "layout", "schema_hash", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


# ---- the template ------------------------------------------------------------------


def format_chats(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """``conv_id, formatted, loss_spans`` from ``conv_id, turn, role, text`` rows.

    ``loss_spans`` holds (start, length) in code points, 0-based, of the texts that
    training scores. A conversation is one string, so its rows meet in one task.

    Defined cases: null roles and texts are empty; turns of equal number follow by role, then
    text; a null turn comes first; a row without conv_id belongs to nothing else and is a
    conversation of its own; repeated rows are repeated turns; extra columns are ignored; an
    empty table gives none.
    """
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    t = turns.withColumns({"head": head, "body": escape(F.col("text"))})
    size = F.char_length("head") + F.char_length("body") + len(END)
    piece = F.concat("head", "body", F.lit(END))
    span = F.struct(F.col("start").cast("long").alias("start"), F.char_length("body").cast("long").alias("length"))
    scored = F.when(F.col("role") == loss_role, span)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    named = t.where("conv_id is not null").withColumn("at", F.row_number().over(order))
    named = named.withColumn("start", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("body") - len(END))
    named = named.select("conv_id", F.struct("at", piece.alias("piece"), scored.alias("span")).alias("t"))
    g = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    g = g.select("conv_id", F.array_join("t.piece", "").alias("formatted"), F.filter("t.span", lambda s: s.isNotNull()).alias("loss_spans"))
    loose = t.where("conv_id is null").withColumn("start", F.char_length("head"))
    return g.union(loose.select("conv_id", piece.alias("formatted"), F.array_compact(F.array(scored)).alias("loss_spans")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (array of role, text) and ``loss_text``, both parsed from the output.

    An empty string has no turn; a null one gives nulls; repeated rows are read alike.
    """
    pieces = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: p != "")
    body = lambda p: F.substring(p, len(TURN) + 1, 2147483647)
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(body(p), TEXT, 1)).alias("role"), unescape(F.element_at(F.split(body(p), r"<\|text\|>"), 2)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = canonical_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    # conversation -1 comes in another layout, which its own fingerprint selects
    hostile = spark.sql("SELECT -1L AS conv_id, transform(array('human', 'gpt'), r -> named_struct('from', r, 'value', '</s>[INST] ok [/INST]')) AS conversations")
    d = read_back(format_chats(rows.union(canonical_turns(hostile))))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return d.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t2 AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LOSS_ROLE}'), '') AS loss,
         sum(length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len(TURN + TEXT + END)}) AS formatted_chars
  FROM t2 GROUP BY conv_id, alone
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
