"""Chat formatting by token-level assembly.

Role and text of each turn are encoded separately, with special strings as ordinary
text, and spliced with reserved ids that no encoding can produce: the ids above the vocabulary.
The same conversation as text is

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

per turn.  In roles and texts, every ``<``, run of backslashes, ``|`` gets one more
backslash, so that no control string is left in them; ``unescaped`` takes it away again.
Token positions and the loss mask of a conversation come from prefix sums of segment lengths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.tokencount import load

CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
TRAINED_ROLE = "assistant"


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _reserved(vocabulary: int) -> tuple[int, int, int]:
    """The ids of CONTROLS: the first three that the vocabulary leaves free."""
    return vocabulary, vocabulary + 1, vocabulary + 2


def format_turns(
    turns: DataFrame,
    tokenizer: str,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per turn: conv, position, ids, loss_from, loss_to, start.

    position: 0, 1, ... by turn (ties by role, then text; null turns first).  ids: the turn's
    tokens with its reserved ids.  start: the tokens of the conversation before this
    turn.  loss_from, loss_to: the half-open range of token positions in the conversation whose
    loss counts: the text of assistant turns; equal if there is none.  Null roles and texts are
    empty; null conversations form one; repeated rows are turns of their own; an empty
    table gives no rows; other columns are ignored.
    """
    conv = turns.schema[conv_col].dataType.simpleString()
    turn = turns.schema[turn_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        encoder = copy.deepcopy(load(tokenizer))
        encoder.encode_special_tokens = True
        begin, middle, end = _reserved(encoder.get_vocab_size())
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                roles, texts = ([escaped(x) for x in part.column(i).to_pylist()] for i in (2, 3))
                role_ids, text_ids = (encoder.encode_batch(x, add_special_tokens=False) for x in (roles, texts))
                ids = [[begin, *r.ids, middle, *t.ids, end] for r, t in zip(role_ids, text_ids, strict=True)]
                heads = [len(r.ids) + 2 for r in role_ids]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(heads, pa.int64())],
                    names=["conv", "turn", "role", "text", "ids", "head"],
                )

    clean = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    schema = f"conv {conv}, turn {turn}, role string, text string, ids array<int>, head bigint"
    coded = clean.mapInArrow(encode, schema)
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    n = F.size("ids").cast("bigint")
    start = F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = coded.withColumn("position", (F.row_number().over(order) - 1).cast("bigint")).withColumn("start", start)
    trained = F.col("role") == TRAINED_ROLE
    loss_from = F.col("start") + F.col("head")
    return placed.select(
        F.col("conv").alias(conv_col),
        "position",
        "ids",
        "start",
        loss_from.alias("loss_from"),
        F.when(trained, F.col("start") + n - 1).otherwise(loss_from).alias("loss_to"),
    )


def digests(formatted: DataFrame, tokenizer: str, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, what its formatted tokens and masks say when they are read back.

    conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (characters of the tokens as text, control strings
    and escapes included).  Rows
    of a conversation are read in order, one at a time, so that its length is not bounded by memory.
    """
    conv = formatted.schema[conv_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = load(tokenizer)
        begin, middle, end = _reserved(decoder.get_vocab_size())
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state: list | None = None
        out: list[tuple] = []

        def done() -> None:
            if state is not None:
                out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate([kind, *types])]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            parts, masked = [], []
            for _, ids, start, a, b in rows:
                if ids[0] != begin or ids[-1] != end:
                    raise ValueError("a turn isn't marked")
                cut = ids.index(middle)
                if sum(x >= begin for x in ids) != len(CONTROLS):
                    raise ValueError("a turn has more reserved ids than its own")
                parts += [ids[1:cut], ids[cut + 1 : -1]]
                masked.append(ids[a - start : b - start])
            written = decoder.decode_batch(parts, skip_special_tokens=False)
            texts = [unescaped(x) for x in written]
            losses = [unescaped(x) for x in decoder.decode_batch(masked, skip_special_tokens=False)]
            for k, (conv_id, *_) in enumerate(rows):
                if state is None or state[0] != conv_id:
                    done()
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{texts[2 * k]}\n{texts[2 * k + 1]}\n".encode())
                state[3] += len(losses[k])
                state[4].update(losses[k].encode())
                state[5] += len(written[2 * k]) + len(written[2 * k + 1]) + sum(map(len, CONTROLS))
            yield batch_of()
        done()
        if out:
            yield batch_of()

    ordered = formatted.select(F.col(conv_col).alias("conv"), "ids", "start", "loss_from", "loss_to", "position")
    ordered = ordered.repartition("conv").sortWithinPartitions("conv", "position").drop("position")
    schema = f"conv {conv}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ordered.mapInArrow(read, schema).withColumnRenamed("conv", conv_col)
