"""Notices, recurring lines and record layouts, by example."""


def test_all_notices_of_a_block_are_found():
    from causalbars.llm import licenses

    scanner, names = licenses.Scanner(licenses.TEMPLATES), lambda found: [x[0] for x in found]
    both = "Released under the MIT License. Licensed under CC BY-NC 4.0."
    assert names(scanner.scan(both)) == ["MIT", "CC-BY-NC-4.0"]
    many = " ".join([both, "Licensed under the Apache License, Version 2.0."] * 100)
    assert len(licenses.blocks(many)) == 1 and names(scanner.scan(many)) == ["MIT", "CC-BY-NC-4.0", "Apache-2.0"] * 100


def test_wordings_of_a_license_may_differ_but_for_its_name():
    from causalbars.llm import licenses

    scanner = licenses.Scanner(licenses.TEMPLATES)
    gnu = "under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    want = {
        "Distributed under the MIT License": ["MIT"],
        "Released under MIT license": ["MIT"],
        "licensed under Apache License 2.0": ["Apache-2.0"],
        gnu.format("", 3): ["GPL-3.0"],
        gnu.format("", 2): ["GPL-2.0"],
        gnu.format("Lesser ", 3): ["LGPL-3.0"],
        gnu.format("Affero ", 3): [],
        "Licensed under the Apache License, Version 1.1. Needs 2.0": [],
        "Licensed under CC BY NC 4.0.": [],
        "Licensed under CC BY-SA 3.0.": [],
        "the MIT License is short": [],
        "my driving license expired": [],
    }
    assert {t: [x[0] for x in scanner.scan(t)] for t in want} == want
    own = licenses.Scanner({"own": "Use of this program is granted under house rules 7.", "also": [("Granted under rule", ("rule",))]})
    assert [x[0] for x in own.scan("license: use of this program is granted under house rules 7.")] == ["own"]


def test_long_lines_recur_from_two_documents(spark):
    from causalbars.llm import line_dedup

    line = lambda n: " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n))
    rows = [(1, f"one own line of text\n{line(51)}"), (2, f"{line(51)}\nanother line of some text"), (3, line(50)), (4, line(50))]
    got = {x.doc_id: x.text for x in line_dedup.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "one own line of text", 2: "another line of some text", 3: line(50), 4: line(50)}


def test_records_near_a_layout_are_read_and_others_returned(spark):
    import json

    from causalbars.llm import chat

    told = [("system", "s"), ("user", "q"), ("assistant", "a")]
    near = [{"system": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"system": "s", "prompt": "q", "completion": "a"}, {"instruction": "q", "output": "a", "system": "s"}]
    assert all(chat.turns(x) == told and not chat.unread(x) for x in near)
    both = {"role": "user", "text": "t", "content": "c"}
    assert chat.turns(both) == [("user", "t")] and chat.unread(both)
    records = [json.dumps(x) for x in [*near, both, {"else": "kept"}]]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(records)], "conv_id long, place long, record string")
    got = chat.format_records(df).first()
    assert got.unread == records[3:] and got.unknown == 1 and len(chat.parse(got.formatted)) == 10


def test_compression_ranks_what_wording_confirms():
    from causalbars.llm import licenses

    long, short = "Use of this program is granted to every member under the house rules 7", "house rules 7"
    scanner = licenses.Scanner({"club": [(long, ("house rules 7",))], "house": [(short, ("house rules 7",))]})
    block = "License: Use of this program was granted to every member under the house rules 7 of 1990"
    # The short wording differs in no word, the long one in one, but it shortens the stretch by far more.
    assert [x[:2] for x in scanner.confirm(block)] == [("club", 1)]
    assert [x[0] for x in scanner.confirm(f"{block}. Copyright, other house rules 7")] == ["club", "house"]
