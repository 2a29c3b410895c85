"""Operators against brute force, round trips and odd inputs."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalbars.llm import chat, common, decontaminate, licenses, line_dedup, mixing, neighbours, ngram_join, quality, sharding, token_files

from .conftest import LONG, ODD

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{min(int(rng.expovariate(0.02)), vocabulary)}" for _ in range(n))


# --- 1


def test_token_files_match_the_tokenizer(spark, odd):
    path = public.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    root = common.new_dir(spark, "t")
    token_files.write_token_files(spark, odd, root, path)
    got = sorted(token_files.read_token_files(spark, root, with_ids=True).collect(), key=lambda r: r.start)
    ids = {(d, t): plain.encode(t or "", add_special_tokens=False).ids + [1] for d, t in ODD}
    assert [r.doc_id for r in got] == sorted((d for d, _ in ODD), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.ids in [v for (d, _), v in ids.items() if d == r.doc_id]
        at += r.n_tokens


def test_token_files_of_nothing(spark, none):
    root = common.new_dir(spark, "t")
    token_files.write_token_files(spark, none, root, public.path("word_bpe_49k.json"))
    assert token_files.read_token_files(spark, root).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_piece_encoder_is_exact(name):
    import pyarrow as pa

    path, rng = public.path(name), random.Random(3)
    letters = "aZé'. ,\n\t<|>1ß́ \x1c漢😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(400)] + ["<|endoftext|> x", "IT'S, it's.., <|ENDOFTEXT|>.", None]
    plain = tokenizers.Tokenizer.from_file(path)
    texts += [f"{w}{p}" for w in ("née", "Ünd", "straße", "abc", "x2", "a<b", "naïve'S") for p in ("", ".", ",&&&", "'", "'s", "|>", "***")]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for remembered in (1 << 20, 1):  # all pieces, and those of the last batch
        encoder = token_files.PieceEncoder(path, "<u4", remembered)
        assert encoder.exact == (name == "word_bpe_49k.json")
        for step in (len(texts), 7):
            found = [encoder.encode(pa.array(texts[lo : lo + step], pa.string())) for lo in range(0, len(texts), step)]
            assert [n for _, lens in found for n in lens.tolist()] == [len(w) for w in want]
            assert [i for ids, _ in found for i in ids.tolist()] == [i for w in want for i in w]


def test_encoder_takes_bounded_texts_and_no_description(monkeypatch):
    import pyarrow as pa

    path, sizes = public.path("word_bpe_49k.json"), []
    monkeypatch.setattr(token_files, "TEXT_BYTES", 100)
    monkeypatch.setattr(token_files, "by_pieces", None)  # would fail if a task read the description
    encoder = token_files.PieceEncoder(path, "<u4", exact=True)
    plain, own = tokenizers.Tokenizer.from_file(path), encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: (sizes.append((len(texts), sum(len(t) for t in texts.to_pylist()))), own(texts))[1])
    texts = ["one two three " * (i % 5) for i in range(50)] + ["long words " * 30, None]
    ids, each = encoder.encode(pa.array(texts))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert each.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(sizes) > 5 and all(n == 1 or size <= 100 for n, size in sizes)


# --- 2


def brute_leaks(rows, items, size=10):
    words = lambda t: re.findall(decontaminate.WORD, (t or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER)))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if own := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= own
        out.append((doc, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


def test_decontamination_matches_brute_force(spark, docs):
    rng = random.Random(1)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 11, 25]), 60)) for i in range(30)] + [(30, ""), (31, None), (32, "x x x x x x x x x x x x")]
    rows = [(i, prose(rng, 60, 60)) for i in range(40)]
    rows += [(100 + i, f"{prose(rng, 8)} {items[i][1].upper()}! {prose(rng, 5)} {items[i + 1][1]}") for i in range(20)] + [(200, "x " * 40), (201, None), (202, ""), (200, "x " * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 25, 20_000):  # one broadcast, and many blocks
        got = decontaminate.search(spark, docs(rows), bench, block_bytes=block)
        got = [(r.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), ",".join(r["items"])) for r in got.collect()]
        assert sorted(got, key=str) == brute_leaks(rows, items)
    kept = {r.doc_id for r in decontaminate.clean(spark, docs(rows), bench).collect()}
    assert kept == {d for d, _, n, _ in brute_leaks(rows, items) if n == 0}


def test_decontamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "three four five"), (None, "a b")], "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, list(r["items"])) for r in decontaminate.search(spark, odd, bench).collect()), key=str)
    assert len(got) == len(ODD) and (None, 6, ["1"]) in got and got.count((4, 3, [])) == 2
    assert decontaminate.search(spark, none, bench).count() == 0
    assert decontaminate.search(spark, odd, bench.limit(0)).filter("size(items) > 0").count() == 0


# --- 3


def test_lines_of_recurring_templates_go(spark, docs, odd, none):
    note = lambda i: f"This page was printed on {i}/2024 by user{i}"
    rows = [(i, f"opening line number {'abcdef'[i]} here today\n{note(i)}\nshort one\n\nthe {'uvwxyz'[i]} end of it all") for i in range(6)]
    got = {r.doc_id: r for r in line_dedup.dedup(spark, docs(rows)).collect()}
    assert all(note(i) not in got[i].text and "short one" in got[i].text and got[i].n_dropped >= 1 for i in range(6))
    twice = [(1, note(1)), (2, note(2))]
    assert all(r.n_dropped == 0 for r in line_dedup.dedup(spark, docs(twice)).collect())
    assert line_dedup.dedup(spark, odd).count() == len(ODD) and line_dedup.dedup(spark, none).count() == 0


def test_short_lines_recur_by_their_exact_text(spark):
    rows = [(i, f"All rights reserved.\nPage {i}\nno {'abcdefgh'[i]} here\n" + ("Read more\n" if i < 6 else "")) for i in range(8)]
    got = line_dedup.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.text for x in got} == {i: t.replace("All rights reserved.\n", "") for i, t in rows}
    assert all(x.n_dropped == 1 for x in got)


def test_leaf_generalises_differing_places():
    leaf = line_dedup.Leaf(0.7)
    assert [leaf.add(x.split()) for x in ("a b c d e", "a b c d f", "a x y z w")] == [0, 0, 1]
    assert leaf.templates()[0] == ["a", "b", "c", "d", line_dedup.WILD]


# --- 4


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    x[100:110] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [None] * 32), (None, [1.0] * 32), (5050, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = collections.defaultdict(list)
    for r in neighbours.search(spark, vectors, vectors.filter("vec_id % 50 = 0")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    d = x.astype(float)
    n = np.sqrt((d * d).sum(1))
    hits = 0
    for q in range(0, 3000, 50):
        cos = (d * d[q]).sum(1) / (n * n[q])
        want = [i for i in np.lexsort((np.arange(3000), -cos)) if i != q][:5]
        own = sorted(got[q])
        assert [k for k, _, _ in own] == [1, 2, 3, 4, 5] and q not in [v for _, v, _ in own]
        assert all(s == cos[v] for _, v, s in own)
        hits += len(set(want) & {v for _, v, _ in own})
    assert hits / (60 * 5) >= 0.9 and [v for _, v, _ in sorted(got[100])] == [101, 102, 103, 104, 105] and 5050 not in got
    assert neighbours.search(spark, vectors.limit(0), vectors.limit(0)).count() == 0


def test_neighbours_over_many_cells(spark, monkeypatch):
    """Cells, parts of a hot cell and blocks of queries as many as on a large table; extra columns; queries of no row."""
    for name, size in (("CELL_BYTES", 16 << 10), ("HELD_BYTES", 8 << 10), ("ASKED_BYTES", 1 << 10)):
        monkeypatch.setattr(neighbours, name, size)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((30, 16))[rng.integers(0, 30, 1500)] + 0.3 * rng.standard_normal((1500, 16))
    x[:500] = x[0]  # one point holds a third of the rows
    columns = "vec_id long, embedding array<double>, cell string, known int, width string, spot int"
    vectors = spark.createDataFrame([(i, v.tolist(), "a", 1, "b", 2) for i, v in enumerate(x)], columns).repartition(5)
    asked = [(i, x[i].tolist()) for i in range(0, 1500, 50)] + [(9001, (-x[0]).tolist()), (9002, [1.0] + [0.0] * 15)]
    got = collections.defaultdict(list)
    for r in neighbours.search(spark, vectors, spark.createDataFrame(asked, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    n, hits = np.sqrt((x * x).sum(1)), 0
    for q, v in asked:
        v = np.array(v)
        cos = (x * v).sum(1) / (n * np.sqrt((v * v).sum()))
        want = [i for i in np.lexsort((np.arange(1500), -cos)) if i != q][:5]
        own = [i for _, i in sorted(got[q])]
        assert len(own) == 5
        if q < 500:
            assert own == want
        hits += len(set(want) & set(own))
    assert hits >= 0.9 * 5 * len(asked)


def test_chi_square_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 10) - 18.307) < 1e-3


# --- 5


def test_licenses_are_confirmed_by_wording(spark, docs, odd, none):
    rows = [(1, "some prose here\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 1.1."), (3, "Licensed under the Apache License, Version 2.0. More prose follows."), (4, "my driving license expired")]
    got = {r.doc_id: (r.n_blocks, r.licenses) for r in licenses.scan(spark, docs(rows)).collect()}
    assert got == {1: (1, ["MIT"]), 2: (1, []), 3: (1, ["Apache-2.0"]), 4: (1, [])}
    assert licenses.scan(spark, odd).filter("size(licenses) = 0").count() == len(ODD) and licenses.scan(spark, none).count() == 0


# --- 6


def test_mix_reaches_its_targets(spark, docs):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 300)), ["a", "b", "c", None][i % 4]) for i in range(400)] + [(1000, prose(rng, 30_000), "a"), (1001, None, "b"), (1002, "", "b"), (1003, "hot copy", "c"), (1003, "hot copy", "c")]
    got = mixing.mix(spark, docs(rows)).collect()
    again = mixing.mix(spark, docs(rows).repartition(7)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.copies) for r in rs)
    assert len(got) == len(rows) and key(got) == key(again)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(re.findall(mixing.WORD, t or ""))
    want = {s: 0.0 for s in size}
    weights, left, total = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True)), set(size), float(sum(size.values()))
    while left:
        share = {s: (total - sum(v for k, v in want.items() if k not in left)) * weights[s] / sum(weights[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        if not over:
            want |= share
            break
        want |= {s: 3.0 * size[s] for s in over}
        left -= set(over)
    sources = {(d, len(re.findall(mixing.WORD, t or ""))): s for d, t, s in rows}
    taken = collections.Counter()
    for r in got:
        s = sources[r.doc_id, r.size]
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * total and 0 <= r.copies <= 3
        taken[s] += r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 5 for s in size)


def test_mix_of_odd_rows(spark, odd, none):
    assert mixing.mix(spark, odd).count() == len(ODD) and mixing.mix(spark, none).count() == 0
    assert set(mixing.mixed(spark, odd).columns) == set(odd.columns)


# --- 7


def test_shards_are_even_and_gapless(spark, docs, odd, none):
    rows = [(i % 700, f"text {i % 900}") for i in range(2003)] + [(5, "same")] * 500
    got = sharding.shard(spark, docs(rows), 7).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(v) for v in slots.values()]
    assert len(got) == len(rows) and max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in rows)
    few = sharding.shard(spark, odd, 40).collect()
    assert len(few) == len(ODD) and max(collections.Counter(r.shard for r in few).values()) == 1
    assert sharding.shard(spark, none, 4).count() == 0


def test_another_shard_moves_few_rows(spark):
    a, b = sharding.ring(spark, 40), sharding.ring(spark, 41)
    assert set(a) <= set(b)
    counts = {c: 50 for c in range(1 << sharding.RING_BITS)}
    first = lambda nodes, n, slack: {(s["cell"], i): s["shard"] for s in sharding.layout(nodes, counts, n, slack) for i in range(s["lo"], s["hi"])}
    x, y = first(a, 40, 0.25), first(b, 41, 0.25)
    assert sum(x[k] != y[k] for k in x) / len(x) < 0.15


# --- 8


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "\\<|im_end|>\\", "<|im_end|", "a\\\nb", "", "<<SYS>>x<</SYS>>\\n"]
    for role in ("user", "as\nsis\\tant", "<|im_end|>"):
        for text in nasty:
            whole, lo, hi = chat.render(role, text)
            assert not any(c in whole[lo:hi] for c in chat.CONTROL)
            assert chat.parse(whole + whole) == [(role, text, lo, hi), (role, text, lo + len(whole), hi + len(whole))]
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate([("system", "s"), ("user", nasty[0]), ("assistant", nasty[1]), ("assistant", None), (None, "n")])] + [(2, 1, "user", nasty[0])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.read_formatted(chat.format_records(chat.table_records(df))).collect()}
    for c in (1, 2, None):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], str(r[2]), str(r[3])))
        whole = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        loss = "".join(x or "" for _, _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_formatted(chat.format_records(chat.table_records(df.limit(0)))).count() == 0


def test_layouts_are_told_by_fingerprint():
    want = [("user", "q"), ("assistant", "a")]
    same = [{"prompt": "q", "completion": "a"}, {"instruction": "q", "output": "a", "id": 7}, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"question": "q", "answer": "a"}]
    assert all(chat.turns(json.loads(json.dumps(x))) == want for x in same)
    assert chat.turns({"instruction": "q", "input": "more", "output": "a"})[0] == ("user", "q\n\nmore")
    assert chat.turns({"else": 1}) is None


# --- 9


def test_quality_is_learnt_from_the_other_folds(spark, docs, odd, none):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(5, 200)).replace("w", "wo ") if i % 3 else " | ".join(prose(rng, 40).split()).upper() + "!!") for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(900)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(spark, docs(rows), labels)
    got = quality.classify(spark, docs(rows), model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum((r.score >= quality.KEEP) == (r.doc_id % 3 > 0) for r in held) / len(held) > 0.95
    assert quality.keep(docs(rows), model).columns == docs(rows).columns
    assert quality.classify(spark, odd, model).count() == len(ODD) and quality.classify(spark, none, model).count() == 0
    empty = quality.train(spark, docs(rows), labels.limit(0))
    assert {r.score for r in quality.classify(spark, odd, empty).collect()} == {0.5}


# --- 10


def brute_components(rows, threshold=75):
    sets = {}
    for i, (_, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= threshold * (len(sets[i]) + len(sets[j]) - k):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in least[root(i)] if x is not None]
        out.append((d, len(sets[i]), d if not sets[i] else min(ids, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join_matches_brute_force(spark, docs, monkeypatch, small):
    if small:  # many buckets, blocks of lists, cells and parts of pairs; workers keep their own values
        for name, value in {"BUCKET": 100, "LIST": 4, "CELL": 500, "PAIRS": 3}.items():
            monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(6)
    passage, rows = prose(rng, 60, 2000), []
    for family in range(12):
        base = prose(rng, rng.choice([6, 30, 120, 400]), 3000).split()
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, len(base) // 30])):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            rows.append((len(rows) + 10, " ".join(copy)))
    rows += [(500 + i, f"{prose(rng, 25, 3000)} {passage}") for i in range(40)] + [(600 + i, f"{passage} {i}") for i in range(10)] + [(900, "A b"), (901, "a  B"), (902, ""), (903, None), (902, "")]
    rows += [(None, rows[0][1]), (rows[1][0], rows[1][1])]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(spark, docs(rows)).collect()), key=str)
    assert got == brute_components(rows)
    kept = ngram_join.representatives(spark, docs(rows)).collect()
    firsts = {c for d, n, c in brute_components(rows) if n}
    assert sorted(r.doc_id for r in kept if r.text) == sorted(firsts)


def test_ngram_join_spells_out_no_pairs_of_a_large_family(spark, docs, monkeypatch):
    """Near copies of one text that mostly do not link: candidates grow with the family, not with its square."""
    written, made = common.written, {}

    def counted(spark, df, name, *more, **named):
        made[name] = (out := written(spark, df, name, *more, **named)).count()
        return out

    monkeypatch.setattr(common, "written", counted)
    rng, rows = random.Random(16), []
    base = [f"word{i}" for i in range(150)]
    for i in range(160):
        copy = list(base)
        for at in rng.sample(range(5, 145), 2 + i % 2):
            copy[at] = f"new{rng.random()}"
        rows.append((i, " ".join(copy)))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(spark, docs(rows)).collect()), key=str)
    assert got == brute_components(rows)
    assert made["join-stars"] <= 2 * len(rows)


def family(rng, near, far):
    """Sets like one of 100 shingles: ``near`` ones that link with each other, ``far`` ones that link with nothing."""
    base, out = rng.integers(0, 1 << 63, 100, dtype=np.uint64), []
    for edits in [4] * near + [30] * far:
        own = base.copy()
        own[rng.choice(100, edits, replace=False)] = rng.integers(0, 1 << 63, edits, dtype=np.uint64)
        out.append(np.unique(own))
    return [out[i] for i in rng.permutation(len(out))]


def test_search_of_a_cell_gives_a_forest_of_its_links():
    """Components as by all pairs of queries and index, in fewer rows than components, whatever the family's size."""
    rng = np.random.default_rng(5)
    for near, far, step, comps in [(60, 0, 1, 60), (40, 30, 1, 70), (40, 30, 2, 70), (30, 20, 1, 9), (0, 40, 1, 40), (30, 1, 3, 31)]:
        sets = [x for size in (1, 2) for x in family(rng, near // size, far // size)]
        rows = [(f"s{i}", f"c{i % comps if i < comps else i}", x) for i, x in enumerate(sets)]
        index, queries = rows[:: min(step, 2)], rows[step // 2 :: step]
        up = {c: c for _, c, _ in rows}

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        of, links = {s: c for s, c, _ in rows}, 0
        for _, c, x in queries:
            for _, d, y in index:
                k = len(np.intersect1d(x, y))
                if root(c) != root(d) and 100 * k >= 75 * (len(x) + len(y) - k):
                    up[root(c)] = root(d)
                    links += 1
        want = {c: root(c) for c in up}
        got = ngram_join.search_cell(index, queries)
        assert len(got) == links
        up |= {c: c for c in up}
        for s, t in got:
            assert root(of[s]) != root(of[t])
            up[root(of[s])] = root(of[t])
        assert len(set(map(root, up))) == len(set(want.values())) and all(want[of[s]] == want[of[t]] for s, t in got)


def test_ngram_join_makes_few_links_of_a_family_that_is_not_glued(spark, docs, monkeypatch):
    """Near copies that link with each other but not with the class that their min-hashes' buckets are verified against:
    the search's links grow with the family, not with its square."""
    written, made = common.written, {}

    def counted(spark, df, name, *more, **named):
        made[name] = (out := written(spark, df, name, *more, **named)).count()
        return out

    monkeypatch.setattr(common, "written", counted)
    rng, rows = random.Random(2), []
    base = [f"word{i}" for i in range(150)]
    for i in range(120):
        copy = list(base)
        for at in rng.sample(range(5, 145), 1 if i % 2 else 6):
            copy[at] = f"new{rng.random()}"
        rows.append((i, " ".join(copy)))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(spark, docs(rows)).collect()), key=str)
    assert got == brute_components(rows)
    assert made["join-glued"] < 10 and 50 < made["join-links"] <= 2 * len(rows)


def test_ngram_join_of_odd_rows(spark, odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(spark, odd).collect()), key=str)
    assert got == brute_components(ODD)
    assert ngram_join.join(spark, none).count() == 0


def test_divide_skip_finds_all(tmp_path):
    rng = np.random.default_rng(8)
    for _ in range(200):
        lists = [np.unique(rng.integers(0, 40, rng.integers(0, 30))) for _ in range(rng.integers(1, 25))]
        t = int(rng.integers(1, 12))
        count = np.bincount(np.concatenate(lists), minlength=40) if lists else np.zeros(40)
        records, overlaps = ngram_join.divide_skip([x for x in lists if len(x)], t)
        assert records.tolist() == [i for i in range(40) if count[i] >= t] and overlaps.tolist() == [count[i] for i in records]


# --- the pipeline


def test_pipeline_stages_take_effect(spark, docs, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    items = [(i, prose(rng, 25, 5000)) for i in range(3)]
    good = [(i, prose(rng, rng.randrange(40, 200), 5000)) for i in range(300)]
    bad = [(1000 + i, " | ".join(prose(rng, 60, 50).split()).upper() + "!!") for i in range(120)]
    leaks = [(2000 + i, f"{prose(rng, 50, 5000)} {items[i % 3][1]} {prose(rng, 20, 5000)}") for i in range(6)]
    copies = [(3000 + i, good[i][1]) for i in range(10)]
    docs([*good, *bad, *leaks, *copies]).drop("hit", "row").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1) for i in range(200)] + [(1000 + i, 0) for i in range(100)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        now = common.written(spark, stage(spark, now, str(tmp_path)), "t")
        kept.append(collections.Counter(r.doc_id for r in now.select("doc_id").collect()))
    assert not any(d in kept[0] for d, _ in bad[100:]) and sum(d in kept[0] for d, _ in good) >= 290
    assert not any(d in kept[1] for d, _ in copies if d - 3000 in kept[0]) and set(kept[1]) >= {d for d, _ in good if d in kept[0]}
    assert not any(d in kept[2] for d, _ in leaks) and set(kept[2]) >= {d for d, _ in good if d in kept[0]}
    assert kept[3] == kept[4] and max(kept[3].values()) <= 3
    assert collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == kept[4]


@pytest.mark.parametrize("links", [10_000, 20])
def test_components(spark, monkeypatch, links):
    from causalbars.llm import components

    monkeypatch.setattr(components, "LINKS", links)
    rng = random.Random(11)
    pairs = [(f"n{a:03d}", f"n{b:03d}") for a, b in ((rng.randrange(150), rng.randrange(150)) for _ in range(100))] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.component for r in components.components(spark, spark.createDataFrame(pairs, "u string, v string")).collect()}
    assert got == {x: root(x) for p in pairs for x in p if p[0] != p[1]}


@pytest.mark.parametrize("dense", [16, 2])
def test_many_links_of_few_nodes_make_few_rows(spark, monkeypatch, dense):
    """Each node with many heads, as in a family of near copies: contracted rows are bounded by the nodes, and no rounds
    follow."""
    from causalbars.llm import components

    written, made = common.written, []

    def counted(*args, **named):
        made.append((out := written(*args, **named)).count())
        return out

    monkeypatch.setattr(common, "written", counted)
    monkeypatch.setattr(components, "LINKS", 50)
    monkeypatch.setattr(components, "DENSE", dense)
    pairs = [(f"n{i:02d}", f"h{j:02d}") for i in range(30) for j in range(12)]
    got = {r.node: r.component for r in components.components(spark, spark.createDataFrame(pairs, "u string, v string")).collect()}
    assert got == {x: "h00" for p in pairs for x in p}
    assert made[0] == 360 and made[-1] == 41 and len(made) == (2 if dense == 16 else 3)


def test_written_tables_leave_no_shuffle_files(spark):
    import pathlib

    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    held = lambda: {p for d in folders for p in pathlib.Path(d).rglob("shuffle_*.data")}
    before = held()
    common.written(spark, spark.range(1000).repartition(3, "id"), "t")
    assert not held() - before
    assert spark.conf.get(common._CLEANUP) == "false"


def test_stages_keep_columns_of_any_name(spark, odd):
    names = {"lang": "_id", "hit": "_hash", "row": "_copies", "n_chars": "_copy"}
    clash = odd.withColumnsRenamed(names)
    bench = spark.createDataFrame([(1, "three four five")], "item_id long, text string")
    for got in (decontaminate.clean(spark, clash, bench), ngram_join.representatives(spark, clash), mixing.mixed(spark, clash)):
        assert got.columns == clash.columns and got.count() > 0


def test_large_keys_are_not_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    rows = [(i, f"text {i}") for i in range(20)]
    keys = docs(rows[:15]).select("doc_id", F.xxhash64("text").alias("text_hash"))
    got = common.by_key(docs(rows), keys, "left_anti")
    assert {r.doc_id for r in got.collect()} == set(range(15, 20)) and "Broadcast" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_shared_folder_is_never_local_on_a_cluster():
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda name, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    conf = SimpleNamespace(get=lambda name, default: "hdfs://store/tmp/")
    assert common.shared_dir(SimpleNamespace(conf=conf)) == "hdfs://store/tmp"
