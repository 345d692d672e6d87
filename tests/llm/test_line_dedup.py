import hashlib
import random
from collections import defaultdict

import pytest

from riskloom.llm import line_dedup as d

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders[key(line)].add(i)
    hot = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in hot or (i is not None and hot[key(x)] == i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows(n, seed):
    draw = random.Random(seed)
    pool = ["Shared line number %d, long enough to be counted here" % k for k in range(30)]
    pool += ["é" * 39, "é" * 40, "x" * 39, "  PADDED Line That Is Forty Characters Or More Long\t", "padded line that is forty characters or more long"]
    out = []
    for i in range(n):
        lines = [draw.choice([*pool, "own line %d of the document, which nobody else has" % draw.randrange(10**9), "", "short"]) for _ in range(draw.randrange(8))]
        out.append((i, "\n".join(lines)))
    return out + [(None, "\n".join(pool)), (3, pool[0] + "\n" + pool[0]), (n, None), (n + 1, ""), (5, "")]


@pytest.mark.parametrize("broadcast_bytes", [d.BROADCAST_BYTES, -1])
@pytest.mark.parametrize("log2", [27, 10])
def test_equals_brute_force(make, broadcast_bytes, log2):
    """Also with filters so small that most lines are suspects, and on the join path."""
    given = rows(120, 3)
    table = make([(i, t, 7) for i, t in given], "doc_id long, text string, n_lines int")
    got = d.dedup_lines(table, broadcast_bytes=broadcast_bytes, filter_log2=log2).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=repr) == brute(given)
    assert all(r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in got)


def test_empty_table_and_columns(make):
    empty = make([], "doc_id long, text string, lang string")
    assert d.dedup_lines(empty).columns == ["doc_id", "text", "lang", "n_lines", "n_dropped", "kept_sha256"]
    assert d.dedup_lines(empty).count() == 0
    assert d.dedup_lines(empty, with_text=False).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
