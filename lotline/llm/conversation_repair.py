"""Repair of a conversation's structure by a suffix-shared automaton of role and fault signatures.

*Signatures.* The rows of a conversation, by turn, become one letter each: the initial of the role, in capitals if the row
is truncated, or ``x`` if it must go, being blank or a duplicate. Conversations of one signature need the same edits.

*Automaton.* Signatures are read from their ends: the nodes of the automaton are the different endings of all
signatures, and a node leads to the ending one letter shorter. Reversed signatures are dealt out by range and sorted, so
that those sharing an ending are neighbours; a task holds the nodes of one path only, and makes a node once for all
signatures through it (an ending that two ranges share, once in either).

*Cost-to-go.* A node has, for each state of the grammar ``(s?(ua)+)?``, the least cost of edits from there to the end of the
conversation and the first letter of the best of them. From one state different edits have different initials, so the
ASCII-least audit of those of least cost follows the smaller letter at every step and no suffix is ever compared or copied.

Edits: K(eep) 0, R(erole) to the role the grammar waits for 1, D(elete) 2, I(nsert) an empty row of that role 5; a truncated
row that isn't deleted adds 5.

A conversation is one sequence, and so is its audit: its rows stream through one task in sorted order (Spark's sort
spills), which remembers one letter a row. Rows of one turn are taken in order of role and then of hashes of role and
text; null turns come first. A null role or text is one space, as white space alone is blank. Null conv_ids are one
conversation. Repeated rows are duplicates after the first. An empty table gives empty results. Columns other than conv_id,
turn, role and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from lotline.llm.common import WHITE_CHARS, cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
WAITED = ("u", "u", "a", "u")
"""The role that the grammar waits for at its start, after s, after u and after a."""
AFTER = {"s": 1, "u": 2, "a": 3}
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
END = ((0, ""), (2 * INSERT, "I"), (INSERT, "I"), (0, ""))
"""(cost, first edit) of each state where no rows are left."""


def ending(letter: str, rest: tuple) -> tuple:
    """The node for ``letter`` before the ending ``rest``: (cost, first edit) of each state."""
    must_go, truncated = letter == "x", letter.isupper()
    role, extra = letter.lower(), TRUNCATED if truncated else 0
    best = []
    for state, waited in enumerate(WAITED):
        options = [(DELETE + rest[state][0], "D")]
        if not must_go:
            options.append((REROLE + extra + rest[AFTER[waited]][0], "R"))
            if role == waited or role == "s" and state == 0:
                options.append((KEEP + extra + rest[AFTER[role]][0], "K"))
        best.append(min(options))
    for _ in range(2):  # after two inserts the state is one of before
        best = [min(b, (INSERT + best[AFTER[WAITED[state]]][0], "I")) for state, b in enumerate(best)]
    return tuple(best)


def audit(signature: str, path: list[tuple]) -> str:
    """The best edits of a signature; ``path`` has the nodes of its endings, the empty one first."""
    edits, state, left = [], 0, len(signature)
    while edit := path[left][state][1]:
        edits.append(edit)
        if edit == "I" or edit == "R":
            state = AFTER[WAITED[state]]
        elif edit == "K":
            state = AFTER[signature[len(signature) - left].lower()]
        left -= edit != "I"
    return "".join(edits)


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted reversed signatures to (reversed, cost, audit): the walk of the automaton, node by node."""
    path, before = [END], ""
    for batch in batches:
        costs, audits = [], []
        for backwards in batch.column(0).to_pylist():
            shared = 0
            for a, b in zip(before, backwards):
                if a != b:
                    break
                shared += 1
            del path[shared + 1:]
            for letter in backwards[shared:]:
                path.append(ending(letter, path[-1]))
            before = backwards
            costs.append(path[-1][0][0])
            audits.append(audit(backwards[::-1], path))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string())],
                                         names=["backwards", "cost", "audit"])


def _content(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and two hashes of role and text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    plain = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return plain.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", "role")})


def _letters(rows: DataFrame) -> DataFrame:
    """One slim row for each row: initial, fault and whether it is a duplicate."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE_CHARS)), -1, 1)
    slim = rows.select("conv_id", "turn", "role", "h1", "h2", (last == "").alias("is_blank"),
                       (~last.isin(".", "!", "?")).alias("is_open")).repartition("conv_id")
    # partitioned by conv_id already: this sorts, and shuffles nothing
    same = Window.partitionBy("conv_id", "h1", "h2").orderBy(F.col("turn").asc_nulls_first())
    return slim.withColumn("is_again", F.row_number().over(same) > 1)


def _signatures(conv: pa.DataType):
    """Arrow batches of letters, sorted by conversation and place, to one row per conversation."""
    schema = pa.schema([("conv_id", conv), ("signature", pa.string())]
                       + [(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_one, out = None, False, []

        def close():
            low, high, turns, last, letters, counts, initial = held[1:]
            gaps = 0 if low is None else high - low + 1 - turns
            out.append((held[0], letters.decode(), gaps, *counts))

        for batch in batches:
            for conv_id, turn, role, is_blank, is_open, is_again in zip(*(c.to_pylist() for c in batch.columns)):
                if not open_one or conv_id != held[0]:
                    if open_one:
                        close()
                    held, open_one = [conv_id, None, None, 0, None, bytearray(), [0, 0, 0, 0], None], True
                if turn is not None and (held[4] is None or turn != held[4]):
                    held[1] = turn if held[1] is None else held[1]
                    held[2], held[4] = turn, turn
                    held[3] += 1
                initial, counts = role[:1], held[6]
                letter = initial if initial in ("s", "u", "a") else "o"
                if is_blank or is_again:
                    letter = "x"
                    counts[0 if is_blank else 1] += 1
                elif is_open:
                    letter = letter.upper()
                    counts[2] += 1
                if held[7] is not None and held[7] + initial not in LEGAL:
                    counts[3] += 1
                held[5] += letter.encode()
                held[7] = initial
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out \
                else pa.RecordBatch.from_pylist([], schema=schema)
            out.clear()
        if open_one:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows


def repairs(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation."""
    conv = rows.schema["conv_id"].dataType
    place = ["conv_id", F.col("turn").asc_nulls_first(), "role", "h1", "h2"]
    letters = _letters(_content(rows)).sortWithinPartitions(*place)
    out = T.StructType([T.StructField("conv_id", conv), T.StructField("signature", T.StringType())]
                       + [T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal")])
    found = cut_lineage(letters.select("conv_id", "turn", "role", "is_blank", "is_open", "is_again").mapInArrow(
        _signatures(to_arrow_type(conv)), out).withColumn("backwards", F.reverse("signature")))
    kinds = found.select("backwards").distinct().repartitionByRange("backwards").sortWithinPartitions("backwards")
    best = kinds.mapInArrow(walk, "backwards string, cost bigint, audit string")
    return found.join(best, "backwards").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _editor(conv: pa.DataType, turn: pa.DataType):
    """Arrow batches of a conversation's audit followed by its rows, to the repaired rows."""
    schema = pa.schema([("conv_id", conv), ("position", pa.int64()), ("turn", turn), ("role", pa.string()), ("text", pa.string()),
                        ("edit", pa.string())])

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        conv_id, edits, at, state, position = None, "", 0, 0, 0

        def insert():
            nonlocal at, state, position
            while at < len(edits) and edits[at] == "I":
                out.append((conv_id, position, None, ROLES[WAITED[state]], "", "I"))
                at, state, position = at + 1, AFTER[WAITED[state]], position + 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for of, is_row, when, role, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                if not is_row:
                    insert()  # what the conversation before still lacks
                    conv_id, edits, at, state, position = of, found, 0, 0, 0
                    continue
                insert()
                edit, at = edits[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role = ROLES[WAITED[state]]
                state = AFTER[role[:1]]
                out.append((conv_id, position, when, role, text, edit))
                position += 1
            yield batch_of()
        insert()
        yield batch_of()

    return edited


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, text and edit (K, R or I) of the rows of all conversations after their repair.

    ``found`` is what ``repairs`` gives for ``rows``. Rows of a conversation are in order of position in one partition.
    """
    conv, turn = rows.schema["conv_id"].dataType, rows.schema["turn"].dataType
    texts = _content(rows).select("conv_id", F.lit(True).alias("is_row"), "turn", "role", "h1", "h2", "text",
                                  F.lit(None).cast("string").alias("audit"))
    plans = found.select("conv_id", F.lit(False).alias("is_row"), F.lit(None).cast(turn).alias("turn"),
                         F.lit(None).cast("string").alias("role"), F.lit(None).cast("bigint").alias("h1"),
                         F.lit(None).cast("bigint").alias("h2"), F.lit(None).cast("string").alias("text"), "audit")
    both = texts.unionByName(plans).repartition("conv_id").sortWithinPartitions(
        "conv_id", "is_row", F.col("turn").asc_nulls_first(), "role", "h1", "h2")
    out = T.StructType([T.StructField("conv_id", conv), T.StructField("position", T.LongType()), T.StructField("turn", turn)]
                       + [T.StructField(n, T.StringType()) for n in ("role", "text", "edit")])
    return both.select("conv_id", "is_row", "turn", "role", "text", "audit").mapInArrow(
        _editor(to_arrow_type(conv), to_arrow_type(turn)), out)


def _digester(conv: pa.DataType):
    import hashlib

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, digest = None, None
        for batch in batches:
            ids, found = [], []
            for of, position, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                line = f"{role}:{text}".encode()
                if position == 0:
                    if digest:
                        ids.append(conv_id)
                        found.append(digest.hexdigest())
                    conv_id, digest = of, hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, conv), pa.array(found, pa.string())], names=["conv_id", "sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], conv), pa.array([digest.hexdigest()])], names=["conv_id", "sha256"])

    return digests


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the lines ``role:text`` of every conversation that has rows after its repair."""
    conv = repaired.schema["conv_id"].dataType
    out = T.StructType([T.StructField("conv_id", conv), T.StructField("sha256", T.StringType())])
    return repaired.select("conv_id", "position", "role", "text").mapInArrow(_digester(to_arrow_type(conv)), out)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32 of conv_id and turn: dropped, emptied, without marks, repeated, or made a user's."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    plain = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    left = plain.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return left.drop("copy")
