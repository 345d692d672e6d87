import re

from riskloom.llm import license_rules as r

MIT = [r.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-as-is")]
BSD = [r.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")]


def wrap(text, width=70, mark=" * "):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(mark + line)
            line = ""
        line += word + " "
    return "\n".join([*lines, mark + line])


def scan(make, texts):
    rows = r.scan_licenses(make(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(x.n_known, x.sentences, x.licenses) for x in sorted(rows, key=lambda x: x.doc_id)]


def test_every_sentence_passes_the_gate_and_is_itself():
    known = r.known_sentences()
    assert len(known) == len(r.SENTENCES)
    for sentence in r.SENTENCES.values():
        assert re.search(r.GATE, sentence)
        assert len(wrap(sentence).split("\n")) <= r.MOST_LINES


def test_rules_follow_the_order(make):
    got = scan(
        make,
        [
            wrap(" ".join(MIT)),
            " ".join(reversed(MIT)),
            "\n".join(BSD),
            "\n".join([*BSD, r.SENTENCES["bsd-endorse"]]),
            "Prose before it. Licensed under CC BY-NC 4.0.\nand after\n# SPDX-License-Identifier: Apache-2.0",
            "released under the mit license",
            "We wrote this and it was not released under the MIT License at all, sorry.",
            None,
            "",
            "license " * 50000 + "\nReleased under the MIT License.",
        ],
    )
    assert got[0] == (3, "mit-grant,mit-notice,mit-as-is", "MIT")
    assert got[1][0] == 3 and got[1][2] == ""
    assert got[2][2] == "BSD-2-Clause" and got[3][2] == "BSD-3-Clause"
    assert got[4] == (2, "cc-by-nc,spdx-apache", "Apache-2.0,CC-BY-NC-4.0")
    assert got[5] == (1, "mit-reference", "MIT")
    assert got[6:9] == [(0, "", "")] * 3
    assert got[9] == (1, "mit-reference", "MIT")


def test_columns_and_empty_table(make):
    table = make([(1, "Released under the MIT License.", "x"), (1, "Released under the MIT License.", "x"), (None, "a", "x")], "doc_id long, text string, licenses string")
    assert sorted(x.licenses for x in r.scan_licenses(table).collect()) == ["", "MIT", "MIT"]
    assert r.scan_licenses(make([], "doc_id long, text string")).count() == 0


def test_sentences_wrapped_at_any_width(make):
    """Down to one word a line; against brute force over all runs of fragments."""
    known = r.known_sentences()
    whole = [" ".join(MIT), "Notes before. " + " ".join(BSD) + " Licensed under the Apache License, Version 2.0 (the \"License\");"]
    texts = [wrap(t, width, mark) for t in whole for width in (1, 20, 30, 44, 60) for mark in (" * ", "# ")]
    want = []
    for text in texts:
        f = r.fragments_of(text)
        ends = lambda i: [n for n in range(i + 1, len(f) + 1) if " ".join(f[i:n]) in known]
        want.append(",".join(known[" ".join(f[i : max(ends(i))])] for i in range(len(f)) if ends(i)))
    got = scan(make, texts)
    assert [x[1] for x in got] == want
    assert [x[2] for x in got[:10]] == ["MIT"] * 10 and [x[2] for x in got[10:]] == ["BSD-2-Clause"] * 10


def test_further_licences(make):
    more = r.MORE_SENTENCES
    assert len(r.all_sentences()) == len(r.SENTENCES) + len(more)
    assert all(re.search(r.MORE_GATE, s) for s in more.values())
    got = scan(make, [s for _, ids in r.MORE_RULES for s in (wrap(" ".join((r.SENTENCES | more)[i] for i in ids), 40),)])
    assert [x[2] for x in got] == [name for name, _ in r.MORE_RULES]
    texts = {
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "# SPDX-License-Identifier: GPL-2.0+": "GPL-2.0-or-later",
        "Released under the Unlicense.": "Unlicense",
        "// SPDX-License-Identifier: MPL-2.0\nint x;": "MPL-2.0",
        "This is free and unencumbered software released into the public\ndomain.": "Unlicense",
        "It was never released under the ISC License, sorry.": "",
    }
    assert [x[2] for x in scan(make, list(texts))] == list(texts.values())
