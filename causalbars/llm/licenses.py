"""License scans by conditional compression.

A document's candidate blocks are the lines around a licensing cue. Every wording of every license is looked for at every
place of a block that holds its distinguishing words (the license's name and version). The stretch there is compressed
plainly and with the wording as a zstandard raw dictionary, and candidates are ranked by the bytes that this saves. In that
order they are confirmed, none left out: the distinguishing words must stand exactly and unbroken; a word-by-word comparison
lists what differs of the other words, of which a bounded share may. All confirmed wordings that do not overlap are found,
however many a block holds; of overlapping ones the best ranked.

Cues are looked for by the scan itself, so only documents with a candidate leave the JVM.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.llm import common

#: Wordings of common notices by license, each with its phrases that must stand exactly. Callers may pass
#: their own, full license texts as well, as (text, phrases) or as plain texts, whose words with digits must then stand.
_VERBS = ("Released under", "Licensed under", "Distributed under", "Available under")


def _named(name: str, *phrases: str) -> list[tuple[str, tuple[str, ...]]]:
    return [(f"{verb} {name}", phrases) for verb in _VERBS]


def _spdx(*ids: str) -> list[tuple[str, tuple[str, ...]]]:
    return [(f"SPDX-License-Identifier: {x}", (f"SPDX-License-Identifier {x}",)) for x in ids]


def _cc(kind: str) -> list[tuple[str, tuple[str, ...]]]:
    full = {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-SA": "Attribution-ShareAlike"}[kind]
    long = [w for name in (f"Creative Commons {full} 4.0", f"Creative Commons {full} International 4.0") for w in _named(f"a {name}", name)]
    return _named(f"CC {kind} 4.0", f"CC {kind} 4.0") + _named(f"CC-{kind}-4.0", f"CC-{kind}-4.0") + _named(f"CC-{kind} 4.0", f"CC-{kind} 4.0") + long + _spdx(f"CC-{kind}-4.0")


def _gnu(name: str, short: str, n: int) -> list[tuple[str, tuple[str, ...]]]:
    full = f"GNU {name}General Public License"
    header = f"under the terms of the {full} as published by the Free Software Foundation,"
    out = [(f"This work is licensed under the {full}, version {n}.", (full, f"version {n}")), (f"This work is licensed under the {full} v{n}", (full, f"v{n}")), (f"under the terms of the {full} v{n}", (full, f"v{n}"))]
    out += [(f"{header} either version {n} of the License, or (at your option) any later version", (full, f"version {n} of the license"))]
    out += [(f"{header} version {n} of the License", (full, f"version {n} of the license")), (f"{header} version {n}", (full, f"version {n}"))]
    out += [w for verb in ("GNU ", "") for x in (f"{short}v{n}", f"{short}-{n}.0", f"{short} v{n}") for w in _named(f"the {verb}{x}", f"{verb}{x}")]
    return out + _spdx(*(f"{short}-{n}.0{x}" for x in ("", "-only", "-or-later", "+")))


TEMPLATES = {
    "Apache-2.0": _named("the Apache License, Version 2.0.", "Apache License", "2.0") + _named("the Apache-2.0 license", "Apache-2.0") + _named("the Apache 2.0 license", "Apache 2.0") + _spdx("Apache-2.0"),
    "BSD-3-Clause": [("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms"))],
    "CC-BY-4.0": _cc("BY"),
    "CC-BY-NC-4.0": _cc("BY-NC"),
    "CC-BY-SA-4.0": _cc("BY-SA"),
    "CC0-1.0": [("Released under CC0 1.0, dedicated to the public domain.", ("CC0 1.0",)), *_named("CC0 1.0", "CC0 1.0"), *_named("CC0-1.0", "CC0-1.0"), *_named("CC0 1.0 Universal", "CC0 1.0"), *_spdx("CC0-1.0")],
    "GPL-2.0": _gnu("", "GPL", 2),
    "GPL-3.0": _gnu("", "GPL", 3),
    "LGPL-3.0": _gnu("Lesser ", "LGPL", 3),
    "MIT": _named("the MIT License.", "MIT License") + _named("MIT", "under MIT") + [(f"{x} MIT license", (f"{x} MIT license",)) for x in ("or", "and", "or the", "and the")] + _spdx("MIT"),
    "MIT text": [("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge"))],
    "MPL-2.0": [("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("Mozilla Public License", "2.0")), *_named("the Mozilla Public License, version 2.0", "Mozilla Public License", "2.0"), *_named("the MPL 2.0", "MPL 2.0"), *_named("the MPL-2.0", "MPL-2.0"), *_spdx("MPL-2.0")],
}
CUE = r"(?i)licen[sc]e|copyright|public domain|\bCC[ -]?(?:BY|0)|Redistribution and use|hereby granted"
#: Words of a candidate block before and after a cue, the share of a wording's words that may differ, and the words that
#: may differ of a short one, of whose free words (those of no phrase) at least half must stand.
BEFORE, AFTER, DIFFER, SPARE = 12, 40, 0.1, 2
WORD = re.compile(r"[\w.-]*\w", re.UNICODE)


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def blocks(text: str) -> list[str]:
    """Stretches of words around the cues; cues whose stretches touch share one."""
    spans: list[list[int]] = []
    at = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    starts = [a for a, _ in at]
    import bisect

    for m in re.finditer(CUE, text):
        i = max(bisect.bisect_right(starts, m.start()) - 1, 0)
        lo, hi = max(i - BEFORE, 0), min(i + AFTER, len(at) - 1)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    return [text[at[lo][0] : at[hi][1]] for lo, hi in spans if at]


class Wording:
    """One wording of a license: its words and where its phrases stand among them."""

    def __init__(self, text: str, phrases: tuple[str, ...] | None = None):
        self.text, self.words = text, words(text)
        wanted = [words(p) for p in phrases] if phrases is not None else [[w] for w in self.words if re.search(r"\d", w)]
        self.phrases, at = [], 0
        for p in wanted:
            at = next(i for i in range(at, len(self.words)) if self.words[i : i + len(p)] == p)
            self.phrases.append((at, at + len(p)))
            at += len(p)
        n = len(self.words)
        self.free = n - sum(b - a for a, b in self.phrases)
        self.spare = max(int(DIFFER * n), min(SPARE, self.free // 2))

    def places(self, have: list[str], at: dict[str, list[int]]):
        """Where the wording may start in ``have``, whose words stand at ``at``."""
        if self.phrases:
            a, b = self.phrases[0]
            return [i - a for i in at.get(self.words[a], ()) if have[i : i + b - a] == self.words[a:b]]
        return sorted({i - k for k, w in enumerate(self.words[:2]) for i in at.get(w, ())})

    def stands(self, have: list[str], start: int) -> tuple[int, int, int, list[str]] | None:
        """(words that differ, first place, end, what differs) if the wording stands about ``start``, else None."""
        lo = max(start - SPARE, 0)
        near = have[lo : max(start, 0) + len(self.words) + 2]
        same = SequenceMatcher(None, self.words, near, autojunk=False)
        place = {a + k: b + k for a, b, n in same.get_matching_blocks() for k in range(n)}
        if len(self.words) - len(place) > self.spare:
            return None
        for a, b in self.phrases:
            if any(k not in place for k in range(a, b)) or place[b - 1] - place[a] != b - 1 - a:
                return None
        first, end = min(place.values()), max(place.values()) + 1
        used = set(place.values())
        if any(re.search(r"\d", near[k]) for k in range(first, end) if k not in used):
            return None
        differ = [f"-{' '.join(self.words[a:b])}+{' '.join(near[c:d])}" for op, a, b, c, d in same.get_opcodes() if op in ("replace", "delete")]
        return len(self.words) - len(place), lo + first, lo + end, differ


class Scanner:
    """Wordings with their dictionaries, ready to confirm and weigh."""

    def __init__(self, templates: dict, level: int = 3):
        import zstandard as zstd

        several = {n: [t] if isinstance(t, (str, tuple)) else t for n, t in templates.items()}
        self.wordings = [(n, Wording(*([t] if isinstance(t, str) else t))) for n in sorted(several) for t in several[n]]
        self.plain = zstd.ZstdCompressor(level=level)
        self.given = [zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(w.text.encode().ljust(8), dict_type=zstd.DICT_TYPE_RAWCONTENT)) for _, w in self.wordings]

    def reduction(self, i: int, stretch: str) -> float:
        """The share of the stretch's compressed size that the wording saves."""
        data = stretch.encode()
        return 1 - len(self.given[i].compress(data)) / len(self.plain.compress(data))

    def saved(self, i: int, stretch: str) -> int:
        """Bytes by which the wording shortens the compressed stretch."""
        data = stretch.encode()
        return len(self.plain.compress(data)) - len(self.given[i].compress(data))

    def ranked(self, block: str, have: list[str]) -> list[tuple[int, int]]:
        """(wording, place) of all candidates: places where a wording's phrases may stand, by the bytes that it saves of
        the stretch there, most first. None is left out; ties go by name and place."""
        at: dict[str, list[int]] = {}
        for i, w in enumerate(have):
            at.setdefault(w, []).append(i)
        spans = [m.span() for m in WORD.finditer(block)]
        found = []
        for i, (name, w) in enumerate(self.wordings):
            for place in w.places(have, at):
                lo, hi = max(place - SPARE, 0), min(max(place, 0) + len(w.words) + 2, len(spans))
                found.append((-self.saved(i, block[spans[lo][0] : spans[hi - 1][1]]), name, place, i))
        return [(i, place) for _, _, place, i in sorted(found)]

    def confirm(self, block: str) -> list[tuple[str, int, int, int, int]]:
        """(license, words that differ, start, end, wording) of all wordings that stand in the block and do not overlap:
        candidates are confirmed in the order of their ranks, so that of overlapping ones the best ranked stays."""
        have = words(block)
        taken, found = [False] * len(have), []
        for i, place in self.ranked(block, have):
            name, w = self.wordings[i]
            if (d := w.stands(have, place)) is not None and not any(taken[d[1] : d[2]]):
                n, lo, hi, _ = d
                taken[lo:hi] = [True] * (hi - lo)
                found.append((name, n, lo, hi, i))
        return sorted(found, key=lambda x: x[2])

    def scan(self, text: str) -> list[tuple[str, float, int, str]]:
        """(license, reduction, differing words, stretch) of each confirmed wording of each block."""
        found = []
        for block in blocks(text):
            spans = None
            for name, n, lo, hi, i in self.confirm(block):
                spans = spans or [m.span() for m in WORD.finditer(block)]
                stretch = block[spans[max(lo - BEFORE, 0)][0] : spans[min(hi + AFTER, len(spans)) - 1][1]]
                found.append((name, self.reduction(i, stretch), n, stretch))
        return found


def _scan(templates: dict):
    def run(batches):
        import pyarrow as pa

        scanner, schema = Scanner(templates), pa.schema([("doc_id", pa.int64()), ("n_blocks", pa.int64()), ("licenses", pa.list_(pa.string())), ("reduction", pa.float64()), ("differing", pa.int64())])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = scanner.scan(text)
                rows.append({"doc_id": doc_id, "n_blocks": len(blocks(text)), "licenses": sorted({f[0] for f in found}), "reduction": max((f[1] for f in found), default=None), "differing": min((f[2] for f in found), default=None)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def scan(spark: SparkSession, docs: DataFrame, templates: dict | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_blocks (candidates), licenses (confirmed, sorted), reduction (the best
    confirmed one's) and differing (words that differ from the wording, least of the confirmed).

    Null and empty texts have no candidates; repeated rows give a row each; other columns are ignored.
    """
    common.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cued = F.col("text").rlike(CUE)
    found = rows.filter(cued).mapInArrow(_scan(templates or TEMPLATES), "doc_id long, n_blocks long, licenses array<string>, reduction double, differing long")
    return found.unionByName(rows.filter(~cued).selectExpr("doc_id", "0L AS n_blocks", "cast(array() AS array<string>) AS licenses", "cast(NULL AS double) AS reduction", "cast(NULL AS bigint) AS differing"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, common.table(spark, sf_dir, "documents"))
