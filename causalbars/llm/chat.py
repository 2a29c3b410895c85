"""Chat formatting by schema fingerprints.

A record is a JSON object in one of several layouts. Its nested field paths, without those that no layout knows, are
hashed to a fingerprint, which selects a declarative mapping from the record to canonical turns of role and text; without
one of its own, a record takes the layout with the most of its paths, and a system field leads as a turn of its own.
Records of no layout, and those with known fields that their layout does not read, are returned beside the text. Turns
are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings within roles and texts are broken by a
backslash after their first character and backslashes are doubled, so that reading a rendered text back is exact.

Records of a conversation are brought together in order and rendered as they stream by; a conversation leaves as pieces
of about ``PIECE_CHARS``, so none needs to fit in memory.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.llm import common

#: Control strings of the template and of other wide-spread templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE, LOSS_ROLE, PIECE_CHARS = "<|im_start|>", "<|im_end|>\n", "assistant", 1 << 16

#: Layouts: the field paths that tell one, and how its turns are read. "each" walks a list; "turns" names a role with
#: the fields that are joined by a blank line; "alias" renames roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = [
    {"paths": ["role", "text"], "each": None, "role": "role", "text": "text"},
    {"paths": ["role", "content"], "each": None, "role": "role", "text": "content"},
    {"paths": ["messages[].role", "messages[].content"], "each": "messages", "role": "role", "text": "content"},
    {"paths": ["conversations[].from", "conversations[].value"], "each": "conversations", "role": "from", "text": "value", "alias": ROLES},
    {"paths": ["conversations[].from", "conversations[].value", "system"], "each": "conversations", "role": "from", "text": "value", "alias": ROLES, "turns": [("system", ["system"])]},
    {"paths": ["prompt", "completion"], "turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"paths": ["prompt", "response"], "turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"paths": ["prompt", "response", "system"], "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"paths": ["question", "answer"], "turns": [("user", ["question"]), ("assistant", ["answer"])]},
    {"paths": ["instruction", "output"], "turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"paths": ["instruction", "input", "output"], "turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
]
KNOWN = {p for x in LAYOUTS for p in x["paths"]}

_BREAK = re.compile("|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL))
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def _hash(paths) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


BY_FINGERPRINT = {_hash(x["paths"]): x for x in LAYOUTS}


def paths(record, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; the items of a list share one path."""
    if isinstance(record, dict):
        return {p for k, v in record.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(record, list):
        return {p for v in record for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


@functools.lru_cache(maxsize=4096)
def _mapping(found: frozenset) -> tuple[dict | None, bool]:
    """(layout, whether it reads all known fields): that of the fingerprint, else the one of the most paths among those
    found, the first of equals, with a system turn in front if there is the field."""
    known = found & KNOWN
    if (how := BY_FINGERPRINT.get(_hash(known))) is not None:
        return how, True
    able = [x for x in LAYOUTS if known.issuperset(x["paths"])]
    if not able:
        return None, False
    how = max(able, key=lambda x: len(x["paths"]))
    read = set(how["paths"])
    if "system" in known - read:
        how, read = how | {"turns": [("system", ["system"]), *how.get("turns", [])]}, read | {"system"}
    return how, known == read


def unread(record: dict) -> bool:
    """Whether the record has no layout, or known fields that its layout does not read."""
    return not _mapping(frozenset(paths(record)))[1]


def turns(record: dict) -> list[tuple[str, str]] | None:
    """Canonical turns of a record; None if no layout has its paths."""
    if (how := _mapping(frozenset(paths(record)))[0]) is None:
        return None
    said = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    out = [(role, "\n\n".join(t for f in fields if (t := said(record.get(f))))) for role, fields in how.get("turns", [])]
    if "each" in how:
        for x in [record] if how["each"] is None else record[how["each"]]:
            role = said(x.get(how["role"]))
            out.append((how.get("alias", {}).get(role, role), said(x.get(how["text"]))))
    return out


def escape(text: str) -> str:
    return _BREAK.sub(r"\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it is written, and the range of its text."""
    head, body = OPEN + escape(role).replace("\n", "\\\n") + "\n", escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """The turns of a rendered text and where their texts stand."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


def _format(batches):
    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.list_(pa.int64()))), ("unknown", pa.int64()), ("unread", pa.list_(pa.string()))])
    rows, conv, piece, text, chars, loss, unknown, left, left_chars, open_ = [], None, 0, [], 0, [], 0, [], 0, False

    def flush():
        nonlocal text, chars, loss, unknown, left, left_chars, piece
        rows.append({"conv_id": conv, "piece": piece, "formatted": "".join(text), "loss": loss, "unknown": unknown, "unread": left})
        text, chars, loss, unknown, left, left_chars, piece = [], 0, [], 0, [], 0, piece + 1

    for batch in batches:
        for own, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not open_ or own != conv:
                if open_:
                    flush()
                conv, piece, open_ = own, 0, True
            found = turns(value := json.loads(record))
            unknown += found is None
            if unread(value):
                left.append(record)
                left_chars += len(record)
            for role, said in found or []:
                whole, lo, hi = render(role, said)
                if role == LOSS_ROLE:
                    loss.append([chars + lo, chars + hi])
                text.append(whole)
                chars += len(whole)
            if chars + left_chars >= PIECE_CHARS:
                flush()
            if len(rows) >= 64:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
    if open_:
        flush()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def format_records(records: DataFrame) -> DataFrame:
    """``records(conv_id, place, record)``, record a JSON object, to rendered pieces: conv_id, piece, formatted, loss
    (ranges of code points that training scores: the assistant's texts), unknown (records of no known layout) and unread (as
they came, the records of no layout and those with known fields that their layout does not read).

    Records of a conversation come in the order of ``place``, nulls first, equal places by the record itself; repeated
    records stay. A null conv_id is a conversation of its own. Null roles and texts are empty. Fields that no layout
    knows are ignored.
    """
    ordered = records.select(F.col("conv_id").cast("long").alias("conv_id"), "place", "record").repartition("conv_id").sortWithinPartitions("conv_id", "place", "record")
    return ordered.select("conv_id", "record").mapInArrow(_format, "conv_id long, piece long, formatted string, loss array<array<long>>, unknown long, unread array<string>")


def _digest(batches):
    import pyarrow as pa

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])
    rows, conv, state = [], None, None

    def close():
        n, whole, chars, loss, length = state
        rows.append(dict(zip(names, (conv, n, whole.hexdigest(), chars, loss.hexdigest(), length), strict=True)))

    for batch in batches:
        for r in batch.to_pylist():
            if state is None or r["conv_id"] != conv:
                if state is not None:
                    close()
                conv, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said, _, _ in parse(r["formatted"]):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for lo, hi in r["loss"]:
                said = unescape(r["formatted"][lo:hi])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(r["formatted"])
        if len(rows) >= 256:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if state is not None:
        close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_formatted(pieces: DataFrame) -> DataFrame:
    """Reads rendered pieces back: per conversation its turns' and its scored texts' digests and lengths."""
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "formatted", "loss")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def table_records(rows: DataFrame) -> DataFrame:
    """The table ``conversations(conv_id, turn, role, text)`` as records, one for each row."""
    return rows.select("conv_id", F.col("turn").alias("place"), F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    return read_formatted(common.written(spark, format_records(table_records(rows.unionByName(more))), "chat"))
