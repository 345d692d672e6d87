"""Text, line and URL expressions against plain Python."""

import random
from urllib.parse import urljoin, urlsplit

import regex
from pyspark.sql import functions as F

from riskloom.functions import text as X
from riskloom.functions.regex import located
from riskloom.functions.urls import absolutize, normalize_page_url
from riskloom.operators import repos as R


def _column(spark, values, expr, *more):
    df = spark.createDataFrame([(i, v, *m) for i, (v, *m) in enumerate(zip(values, *more))],
                               "i int, a string" + "".join(f", {n} string" for n, _ in zip("bcd", more)))
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_letter_folding(spark):
    rng = random.Random(1)
    samples = ["".join(rng.choice("abéZ1 .-_,\n") for _ in range(rng.randint(0, 24))) for _ in range(3000)]
    spaced = regex.compile(r"(?<![\p{L}\p{N}])(?:\p{L}[.\-_ ]){2,}\p{L}(?![\p{L}\p{N}])")
    want = [spaced.sub(lambda m: regex.sub(r"[.\-_ ]", "", m.group()), s) for s in samples]
    assert _column(spark, samples, X.fold_separated_letters(F.col("a"))) == want


def test_nfkc_matches_python(spark):
    import unicodedata

    samples = ["plain", "ＲＬＳ", "ﬁne", "é", "Straße", "½", "a b", "日本", "é", "“q”…", "x²"]
    assert _column(spark, samples, X.nfkc(F.col("a"))) == [unicodedata.normalize("NFKC", s) for s in samples]


def test_match_lines(spark):
    rng = random.Random(2)
    parts = ["security definer", "Security\n definer", "x\n", "\n", "-- note\n", "y "]
    samples = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    want = []
    for s in samples:
        want.append([(m.group(), s[: m.start()].count("\n") + 1) for m in regex.finditer(r"(?i)security\s+definer", s)])
    got = _column(spark, samples, located(F.col("a"), R.SECURITY_DEFINER, 0))
    assert [[(m["match"], m["line"]) for m in ms] for ms in got] == want


def test_match_groups_and_passes(spark):
    """Groups and lines as by Python, and the text is read for the matches and between them, not once a group."""
    rng = random.Random(4)
    parts = ["grant ", "select, insert ", "on ", "table ", "public.", "orders ", "to ", "anon", "s ", ";\n", "\n", "PUBLIC ", "Grant all on t to anon"]
    samples = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["grant all on a to anon\n" * 3000]
    want = [
        [(m.group(), *m.groups(), s[: m.start()].count("\n") + 1) for m in regex.finditer("(?i)" + R.GRANT_ANON, s)] for s in samples
    ]
    column = located(F.col("a"), R.GRANT_ANON, 3)
    assert [[tuple(m) for m in ms] for ms in _column(spark, samples, column)] == want
    assert str(column).count("regexp_extract_all") == 1


def test_clauses(spark):
    got = _column(spark, ["a. b!c; d\n\ne .env f?", "...", "v2.1 ok"], X.split_clauses(F.col("a")))
    assert got == [["a", "b!c", "d", "e .env f"], [], ["v2.1 ok"]]


def test_url_resolution_against_urljoin(spark):
    rng = random.Random(3)
    segments = ["a", "b.c", "..", ".", "d-e", "x_y"]
    refs, bases = [], []
    for _ in range(600):
        prefix = rng.choice(["", "/", "//h.example.org/", "http://o.example.org/"])
        # urljoin leaves dots alone in references that name a host.
        usable = [s for s in segments if "example" not in prefix or s.strip(".")]
        path = "/".join(rng.choice(usable) for _ in range(rng.randint(1, 4)))
        refs.append(prefix + path + rng.choice(["", "/", "?q=1", "#f"]))
        bases.append("https://s.example.org/" + "/".join(rng.choice(["p", "q", "r"]) for _ in range(rng.randint(0, 3))))
    got = _column(spark, refs, absolutize(F.col("a"), F.col("b")), bases)
    for ref, base, url in zip(refs, bases, got):
        want = urlsplit(urljoin(base, ref))._replace(fragment="").geturl()
        assert url == want, (ref, base)


def test_page_urls(spark):
    base = "https://x.example.org/"
    cases = {
        "/about/": "https://x.example.org/about",
        "/a?utm_source=m&id=2": "https://x.example.org/a?id=2",
        "/a#top": "https://x.example.org/a",
        "HTTPS://X.example.org:443/b": "https://x.example.org/b",
        "/é é": "https://x.example.org/%C3%A9%20%C3%A9",
        "mailto:a@b.example": None,
        "#top": None,
        "/guide.PDF": None,
        "ftp://x.example.org/f": None,
        "": None,
    }
    got = _column(spark, list(cases), normalize_page_url(F.col("a"), F.lit(base)))
    assert got == list(cases.values())


def test_bytes_and_same_page(spark):
    df = spark.createDataFrame([(900,), (1536,), (1572864,)], "n long")
    assert [r[0] for r in df.select(X.format_bytes(F.col("n"))).collect()] == ["900 B", "2 KB", "1.5 MB"]
    pairs = spark.createDataFrame([("<p>a</p>", " <P>a</p> "), ("a", "b" * 50), ("", "")], "a string, b string")
    assert [r[0] for r in pairs.select(X.same_page(F.col("a"), F.col("b"))).collect()] == [True, False, True]
