"""Cheapest repair of conversations by weighted interval parsing, from rows through blocks of rows to whole conversations."""

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.support import Work
from forecourt.plans.joins import keyed_join

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
#: A block is a run of up to 2 ** so many rows of a conversation, parsed by one call; so many blocks are joined by one call.
BLOCK_BITS, FAN_BITS = 8, 10

_BLANKS = r"\x20\x09-\x0D"
_CLEAN, _EMPTY, _COPY, _CUT = range(4)
_INITIALS = "sua"

# The grammar of conversations, s?(ua)+ or nothing, closed under parts: a span of rows becomes nothing, a lone s, or a
# string of alternating u and a told by its first and last role; S in front says that s comes before. In Chomsky normal
# form every rule joins two of these, so that a span may be parsed from the halves of any cut.
_KINDS = ("", "s", "uu", "ua", "au", "aa", "Su", "Sa")
_ACCEPTED = ("", "ua", "Sa")
_LEGAL = {"su", "ua", "au"}


def _joined(left: str, right: str) -> str | None:
    if not left or not right:
        return left or right
    if right[0] not in "ua" or left[-1] + right[0] not in _LEGAL:
        return None
    return ("S" if left[0] in "sS" else left[0]) + right[-1]


_RULES = [(a, b, _joined(a, b)) for a in _KINDS for b in _KINDS if _joined(a, b) is not None]
_INSERTED = [{kind: (INSERT, "I")} for kind in ("uu", "aa")]


def _better(cell: dict, kind: str, cost: int, audit: str) -> bool:
    """Put a derivation into a cell if it is cheaper than that there, or as cheap with a lesser audit."""
    if kind in cell and cell[kind] <= (cost, audit):
        return False
    cell[kind] = cost, audit
    return True


def combined(left: dict, right: dict) -> dict:
    """The cell of a span from those of its two parts.

    Strings of edits of one span and equal cost are never a beginning of one another, since each edit has its price;
    so the least string of the whole is made of least strings of the parts.
    """
    cell: dict = {}
    for a, b, kind in _RULES:
        if a in left and b in right:
            cost = left[a][0] + right[b][0]
            if kind not in cell or cost <= cell[kind][0]:
                _better(cell, kind, cost, left[a][1] + right[b][1])
    return cell


def closed(cell: dict) -> dict:
    """The cell with all insertions before and after that are of use; parts that are closed make closed wholes."""
    while True:
        found = [combined(cell, i) for i in _INSERTED] + [combined(i, cell) for i in _INSERTED]
        if not any([_better(cell, kind, *derived) for more in found for kind, derived in more.items()]):
            return cell


def _read(row: str) -> tuple[str, int]:
    """Initial (a space for others) and fault of a row, which one letter tells."""
    at, fault = divmod(ord(row) - ord("A"), 4)
    return " sua"[at], fault


@lru_cache(maxsize=None)
def row_cell(row: str) -> dict:
    """The cell of a span of one row."""
    initial, fault = _read(row)
    cell = {"": (DELETE, "D")}
    if fault not in (_EMPTY, _COPY):
        more = UNFINISHED if fault == _CUT else 0
        cell["uu"] = cell["aa"] = (REROLE + more, "R")
        if initial in _INITIALS:
            cell[initial if initial == "s" else 2 * initial] = (KEEP + more, "K")
    return closed(cell)


def _halved(cells: list[dict]) -> dict:
    """Spans of two, four, eight ... of the given ones, up to all of them."""
    while len(cells) > 1:
        pairs = [combined(cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
        cells = pairs + cells[2 * len(pairs) :]
    return cells[0]


def parse(rows: str) -> dict:
    """The cell of a span of rows: kind of role string -> (cost, audit) of its cheapest derivation."""
    return _halved([row_cell(r) for r in rows])


_parse_short = lru_cache(maxsize=20_000)(parse)


def best(cell: dict) -> tuple[int, str, str]:
    """(cost, audit, kind) of a whole conversation."""
    return min((*cell[kind], kind) for kind in _ACCEPTED if kind in cell)


def codes(audit: str, kind: str) -> list[str]:
    """For each row what becomes of it: K kept, D deleted, U or A given that role, u or a inserted before it (after it at the end)."""
    out, before = [], ""
    role = "s" if kind.startswith("S") else "u"
    for edit in audit:
        if edit == "D":
            out.append(before + "D")
            before = ""
            continue
        if edit == "I":
            before += role
        else:
            out.append(before + ("K" if edit == "K" else role.upper()))
            before = ""
        role = "a" if role == "u" else "u"
    if before:
        out[-1] += before
    return out


_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal")
_SPAN = (
    "span struct<n:bigint, blank:bigint, duplicate:bigint, truncated:bigint, illegal:bigint, first:string, last:string, "
    "least:bigint, most:bigint, turns:bigint, cells:array<struct<kind:string, cost:bigint, audit:string>>>"
)


def _span(rows: str, turns: list[int | None]) -> dict:
    """A block of rows in order: its counts, and its cell."""
    read = [_read(r) for r in rows]
    faults = [fault for _, fault in read]
    known = [t for t in turns if t is not None]
    cell = _parse_short(rows) if len(rows) <= 16 else parse(rows)
    return {
        "n": len(rows), "blank": faults.count(_EMPTY), "duplicate": faults.count(_COPY), "truncated": faults.count(_CUT),
        "illegal": sum(a[0] + b[0] not in _LEGAL for a, b in zip(read, read[1:], strict=False)), "first": read[0][0], "last": read[-1][0],
        "least": known[0] if known else None, "most": known[-1] if known else None, "turns": len(set(known)), "cell": cell,
    }


def _joined_spans(spans: list[dict]) -> dict:
    """Spans of one conversation that follow one another, as one."""
    out = {c: sum(s[c] for s in spans) for c in _COUNTS}
    out["illegal"] += sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(spans, spans[1:], strict=False))
    out |= {"first": spans[0]["first"], "last": spans[-1]["last"], "least": None, "most": None, "turns": 0}
    for s in spans:
        if s["turns"]:
            out["turns"] += s["turns"] - (out["most"] == s["least"])
            out["least"] = s["least"] if out["least"] is None else out["least"]
            out["most"] = s["most"]
    return out | {"cell": _halved([s["cell"] for s in spans])}


def _packed(span: dict) -> dict:
    cell = span.pop("cell")
    return span | {"cells": [{"kind": k, "cost": c, "audit": a} for k, (c, a) in cell.items()]}


def _unpacked(span: dict) -> dict:
    return span | {"cell": {c["kind"]: (c["cost"], c["audit"]) for c in span["cells"]}}


def _parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [_packed(_span("".join(r["row"] for r in rows), [r["turn"] for r in rows])) for rows in batch.column("rows").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(spans, _ARROW_SPAN)], names=["conv", "block", "span"])


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [_packed(_joined_spans([_unpacked(s["span"]) for s in listed])) for listed in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(spans, _ARROW_SPAN)], names=["conv", "block", "span"])


_LONG, _TEXT = pa.int64(), pa.string()
_ARROW_SPAN = pa.struct([
    *[(c, _LONG) for c in _COUNTS], ("first", _TEXT), ("last", _TEXT), ("least", _LONG), ("most", _LONG), ("turns", _LONG),
    ("cells", pa.list_(pa.struct([("kind", _TEXT), ("cost", _LONG), ("audit", _TEXT)]))),
])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chosen = [best({c["kind"]: (c["cost"], c["audit"]) for c in cells}) for cells in batch.column("cells").to_pylist()]
        cost, audit, kind = ([c[i] for c in chosen] for i in range(3))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("counts"), pa.array(cost, _LONG), pa.array(audit, _TEXT), pa.array(kind, _TEXT)], names=["conv", "counts", "cost", "audit", "kind"])


def _deal_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The codes of each block of a conversation."""
    for batch in batches:
        for row in batch.to_pylist():
            listed, at = codes(row["audit"], row["kind"]), 0
            out = []
            for block in row["blocks"]:
                out.append({"conv": row["conv"], "block": block["block"], "first": block["first"], "codes": listed[at : at + block["n"]]})
                at += block["n"]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv", _TEXT), ("block", _LONG), ("first", _LONG), ("codes", pa.list_(_TEXT))]))


_NO_CONVERSATION = " "


def _rows(conversations: DataFrame) -> DataFrame:
    """Rows with a key of the conversation that is never null, and a space for a null role or text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    conv = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(_NO_CONVERSATION))
    return conversations.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def _placed(work: Work, rows: DataFrame) -> DataFrame:
    """Rows in order, by a number that grows within each conversation, with their letter.

    A task takes a range of rows, so that a long conversation lies in several. Rows that are equal but for their id are spread too.
    """
    rows = work.store(rows.withColumn("id", F.monotonically_increasing_id()).withColumn(
        "digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    ))
    blank = ~F.regexp_like("text", F.lit(f"[^{_BLANKS}]"))
    first = rows.filter(~blank).groupBy("conv", "digest").agg(F.count("*").alias("times"), F.min(F.struct("turn", "id")).alias("first"))
    first = work.store(first.filter("times > 1").select("conv", "digest", "first"))
    seen = F.coalesce(F.struct("turn", "id") > F.col("first"), F.lit(False))
    cut = ~F.regexp_like("text", F.lit(f"[.!?][{_BLANKS}]*\\z"))
    fault = F.when(blank, _EMPTY).when(seen, _COPY).when(cut, _CUT).otherwise(_CLEAN)
    initial = F.instr(F.lit(_INITIALS), F.substring("role", 1, 1))
    letter = F.char(F.lit(ord("A")) + F.when(F.col("role") == "", 0).otherwise(initial) * 4 + fault)
    order = ["conv", "turn", "_role", "_text", "digest", "id"]
    placed = (
        keyed_join(rows, first, ["conv", "digest"], "left")
        .withColumns({"row": letter, "_role": F.substring("role", 1, 64), "_text": F.substring("text", 1, 64)})
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv", "turn", "role", "text", "row", F.monotonically_increasing_id().alias("place"))
    )
    placed = work.store(placed)
    work.drop(rows, first)
    return placed.withColumn("block", F.shiftright("place", BLOCK_BITS))


def _whole(work: Work, blocks: DataFrame) -> DataFrame:
    """Blocks joined, up to one span for each conversation: at most 2 ** FAN_BITS in one group."""
    whole, open_ = [], blocks
    while True:
        per_conv = work.store(open_.groupBy("conv").agg(F.count("*").alias("spans")).filter("spans > 1"))
        most = per_conv.agg(F.max("spans")).first()[0]
        if most is None:
            return _union([*whole, open_])
        whole.append(open_.join(per_conv, "conv", "left_anti"))
        open_ = open_.join(per_conv.select("conv"), "conv", "left_semi")
        group = F.lit(0).cast("long") if most <= 1 << FAN_BITS else F.shiftright("block", FAN_BITS)
        listed = open_.groupBy("conv", group.alias("group")).agg(F.array_sort(F.collect_list(F.struct("block", "span"))).alias("spans"))
        listed = listed.select("conv", F.col("group").alias("block"), "spans")
        open_ = work.store(listed.mapInArrow(_join_blocks, f"conv string, block long, {_SPAN}"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def repair(conversations: DataFrame, work: Work | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired): the cheapest edits that give every conversation the roles s?(ua)+ or no rows, and the rows after them.

    A row is kept, given the role user or assistant, or deleted, and empty rows of these roles are inserted, at the
    prices above; blank rows and those whose role and text came earlier must be deleted, and a row left whose text
    does not end in ``[.!?]`` costs extra. Of equally cheap edits those whose initials come first in ASCII are taken.

    Rows of a conversation are in the order of turn (null first), role and text (ties: by their first 64 characters,
    then a digest). Each row is a span with a cell of the grammar's kinds, closed under insertions; spans of two,
    four, eight ... rows combine theirs. Since the grammar is closed under parts, one cut of a span is as good as
    all, so cells grow with the rows, not with their square: a block of rows is parsed in one call, and blocks
    of a conversation are joined by groups of bounded number. A conversation's audit is one cell, and eight of them
    meet in one task; otherwise its rows are never gathered, nor its texts.

    A null role or text counts as one space, so such a text is blank and such a role is no initial; an empty role
    is none either. Null conversation ids are one conversation; null turns come first and count in no gap. Repeated rows
    are duplicates of the first. An empty table gives no rows. Other columns are ignored.

    reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit. repaired: conv_id, place (order
    within a conversation), step (order of rows of one place), edit (initial), role, text.
    """
    work = work or Work(conversations.sparkSession)
    placed = _placed(work, _rows(conversations))
    listed = F.array_sort(F.collect_list(F.struct("place", "row", "turn"))).alias("rows")
    gathered = placed.groupBy("conv", "block").agg(listed)
    blocks = work.store(gathered.mapInArrow(_parse_blocks, f"conv string, block long, {_SPAN}"))
    spans = _whole(work, blocks).select("conv", F.col("span").dropFields("cells").alias("counts"), "span.cells")
    counts = spans.schema["counts"].dataType.simpleString()
    chosen = work.store(spans.mapInArrow(_choose, f"conv string, counts {counts}, cost long, audit string, kind string"))

    starts = placed.groupBy("conv", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    starts = starts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "first", "n"))).alias("blocks"))
    dealt = starts.join(chosen.select("conv", "audit", "kind"), "conv").mapInArrow(_deal_codes, "conv string, block long, first long, codes array<string>")
    code = F.element_at("codes", (F.col("place") - F.col("first") + 1).cast("int"))
    steps = F.posexplode(F.split("code", "(?<=.)(?=.)")).alias("step", "edit")
    edited = placed.join(dealt, ["conv", "block"]).select("conv", "place", "role", "text", code.alias("code")).select("conv", "place", "role", "text", steps)
    given = {"u": "user", "a": "assistant"}
    role, text, edit = F.col("role"), F.col("text"), F.col("edit")
    for letter, name in given.items():
        role = F.when(F.lower("edit") == letter, name).otherwise(role)
    conv_id = F.nullif("conv", F.lit(_NO_CONVERSATION)).cast("long").alias("conv_id")
    repaired = edited.filter("edit <> 'D'").select(
        conv_id, "place", "step",
        F.when(edit == "K", "K").when(edit == F.upper(edit), "R").otherwise("I").alias("edit"), role.alias("role"),
        F.when(edit == F.lower(edit), "").otherwise(text).alias("text"),
    )
    c = lambda name: F.col(f"counts.{name}")
    gaps = F.coalesce(c("most") - c("least") + 1 - c("turns"), F.lit(0).cast("long"))
    reports = chosen.select(conv_id, gaps.alias("gaps"), *[c(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal")], "cost", "audit")
    return reports, repaired


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with known damage: by crc32 of conversation and turn, of twenty rows one is dropped, one emptied, one
    loses its ``[.!?]``, one is repeated and one gets the role user. Nulls become one space in the checksum, role and text."""
    said = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.coalesce("text", F.lit(" "))
    return (
        conversations.withColumn("_kind", kind).filter("_kind <> 0")
        .select(
            "conv_id", "turn",
            F.when(F.col("_kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
            F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"),
        )
        .drop("_copy")
    )


def _hash_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come one after the other."""
    now, state, first = None, None, True
    for batch in batches:
        ids, out = [], []
        lines = batch.column("line").cast(pa.large_binary())
        for conv, line in zip(batch.column("conv").to_pylist(), lines, strict=True):
            if conv != now:
                if now is not None:
                    ids.append(now)
                    out.append(state.hexdigest())
                now, state, first = conv, hashlib.sha256(), True
            if not first:
                state.update(b"\n")
            state.update(line.as_buffer())
            first = False
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, _TEXT), pa.array(out, _TEXT)], names=["conv", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["conv", "sha"])


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """Reports on the damaged conversations, with a digest of each one's repaired rows as ``role:text`` lines.

    A conversation's lines pass one after the other through one task, which holds the state of the hash alone.
    """
    reports, repaired = repair(damaged(conversations))
    key = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(_NO_CONVERSATION))
    lines = repaired.select(key.alias("conv"), "place", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    hashed = lines.repartition("conv").sortWithinPartitions("conv", "place", "step").select("conv", "line").mapInArrow(_hash_streams, "conv string, sha string")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), key.alias("conv")).distinct()
    told = ids.join(reports.withColumn("conv", key).drop("conv_id"), "conv", "left").join(hashed, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return told.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
