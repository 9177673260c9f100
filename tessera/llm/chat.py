"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the text of all turns before it, as context, and its reply,
and only the reply is trained on.  So the output of a conversation grows with the square of its length, as the
method says; what a task holds is one conversation's text and a few megabytes of examples.  Turns after the
last reply are no example; they are put out once, without context and target, so that nothing is lost.

The template marks turns by control strings; where these occur inside texts or roles, a backslash is put
after their first character, and backslashes are doubled, so that texts can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands before and after the text of each role.
MARKS = {"system": ("<<SYS>> ", " <</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>\n")}
OTHER = ("[ROLE] ", " [/ROLE] ", " [/TURN]\n")
CONTROLS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(
    "|".join([*(f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKS.items()), f"{re.escape(OTHER[0])}(?P<role>.*?){re.escape(OTHER[1])}(?P<other>.*?){re.escape(OTHER[2])}"]), re.S
)
EXAMPLES = "conv_id long, example int, context_chars long, text string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Characters of text after which a task hands on its rows.
HANDED_ON = 4 << 20


def _made(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names, types = zip(*(x.split() for x in ddl.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)], list(names))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A turn under the template, and where its (escaped) text starts and ends in it."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    own = escape(text)
    return before + own + after, len(before), len(before) + len(own)


def read_turns(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn in a formatted text."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError("not a text of this template")
        name = next(x for x in (*MARKS, "other") if m[x] is not None)
        yield (name if name != "other" else unescape(m["role"])), unescape(m[name]), m.start(name), m.end(name)
        at = m.end()


def ordered(turns: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order; ties by role and text, nulls (empty) first."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example (from 0), context_chars (where the reply's turn starts), text
    (all turns up to and with the reply), loss_start and loss_end (of the escaped reply in it). Turns after the
    last reply make a row with null loss_start and loss_end and context_chars 0.

    Null texts and roles are empty, a null conv_id is a conversation of its own, an unknown role gets a mark that
    names it, and repeated turns are turns. A conversation's text must fit a task and, as a string, 2 GB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, some, example, context, rest, rows, held = None, False, 0, "", [], [], 0

        def close() -> None:
            if rest:
                rows.append((conv, example, 0, "".join(rest), None, None))

        for batch in batches:
            for c, role, said in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if not some or c != conv:
                    close()
                    conv, some, example, context, rest = c, True, 0, "", []
                piece, start, end = turn_text(role, said)
                rest.append(piece)
                if role == "assistant":
                    context += "".join(rest)
                    at = len(context) - len(piece)
                    rows.append((c, example, at, context, at + start, at + end))
                    example, rest, held = example + 1, [], held + len(context)
                    if held > HANDED_ON:
                        yield _made(rows, EXAMPLES)
                        held = 0
            yield _made(rows, EXAMPLES)
        close()
        yield _made(rows, EXAMPLES)

    return ordered(turns).mapInArrow(run, EXAMPLES)


def digests(made: DataFrame) -> DataFrame:
    """Read the turns and the trained text back from the output of examples(), per conversation: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars (of all texts put out).

    The last example has all turns up to the last reply; what is under the masks comes from each example. The
    partitions of examples() hold whole conversations in order; one conversation's text is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, some, last, rest, loss, said, size, rows = None, False, "", "", hashlib.sha256(), 0, 0, []

        def close() -> None:
            turns, n = hashlib.sha256(), 0
            for text in (last, rest):
                for role, own, _, _ in read_turns(text):
                    turns.update(f"{role}\n{own}\n".encode())
                    n += 1
            rows.append((conv, n, turns.hexdigest(), said, loss.hexdigest(), size))

        for batch in batches:
            for c, text, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if not some or c != conv:
                    if some:
                        close()
                    conv, some, last, rest, loss, said, size = c, True, "", "", hashlib.sha256(), 0, 0
                size += len(text)
                if start is None:
                    rest = text
                else:
                    last, own = text, unescape(text[start:end])
                    loss.update(own.encode())
                    said += len(own)
            yield _made(rows, DIGESTS)
        if some:
            close()
        yield _made(rows, DIGESTS)

    return made.mapInArrow(run, DIGESTS)
