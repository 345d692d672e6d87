import random
import re

import zstandard

from riskloom.llm import compression as c


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts_equal_brute_force():
    draw = random.Random(5)
    for _ in range(200):
        text = "".join(draw.choice(["a ", "b ", "é ", "\n", "\t", "#", "c d e ", "\x0b", "\r", "x&"]) for _ in range(draw.randrange(60)))
        assert c.base_counts(text.encode()) == brute(text)


def prose(n, seed=1):
    draw = random.Random(seed)
    syllables = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    return " ".join("".join(draw.choice(syllables) for _ in range(draw.randrange(1, 5))) for _ in range(n))


def test_bands():
    z = zstandard.ZstdCompressor(level=c.LEVEL)

    def verdict(text):
        data = text.encode()
        return c.band_verdict(len(data), *c.compression(data, z))

    for n in (60, 200, 1000, 20000):
        assert verdict(prose(n)) == "kept"
    draw = random.Random(2)
    noise = "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(30000))
    assert verdict(noise).startswith("incompressible")
    assert verdict(prose(30) * 60).startswith("repetitive")
    # Mostly repetitive chunks in a text whose whole ratio is still within its band.
    assert verdict(prose(9000, 3) + "ab " * 25000) in ("repetitive", "repetitive chunks")


def test_rows(make):
    rows = [(1, prose(100), "x"), (2, None, "x"), (3, "", "x"), (None, "a b", "x"), (1, prose(100), "x"), (4, " \n\t", None)]
    got = c.compression_bands(make(rows, "doc_id long, text string, kept string")).collect()
    assert len(got) == 6
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.kept for r in by[1]] == [True, True] and by[1][0].n_words == 100
    assert all(by[k][0].base_failed and not by[k][0].kept and by[k][0].n_words == 0 for k in (2, 3, 4))
    assert by[None][0].n_words == 2
    assert c.compression_bands(make([], "doc_id long, text string")).count() == 0


def test_very_long_text_is_read_whole():
    text = (prose(50000) + "\n").encode() * 3
    counts = c.base_counts(text)
    assert counts[0] == 150000 and counts[3] == 2 and counts[4] == 150000
