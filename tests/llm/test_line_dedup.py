from orderlens.llm import line_dedup as L

A = "The first sentence of the passage has ten words here. " * 1
PASSAGE = " ".join(f"Sentence {w} of this passage holds exactly nine words here." for w in "abcdefgh")


def spans(docs, least=40):
    return {r.doc_id: (r.start, r.stop, r.words, tuple(r.kept_in)) for r in L.repeated_spans(docs, least).collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], "doc_id long, text string, n_chars long, start string")


def test_passage_within_a_line_is_cut_once(spark):
    rows = [
        (4, f"Own words of four.\nand some of {PASSAGE} then more."),
        (2, f"Quite another start, {PASSAGE}"),
        (7, f"{PASSAGE.upper()}\nA tail."),
        (1, "Own words of four. Nothing else."),
        (3, None),
        (5, ""),
        (None, PASSAGE),
    ]
    docs = frame(spark, rows)
    found = spans(docs)
    assert set(found) == {4, 7}
    start, stop, _, kept = found[4]
    assert rows[0][1][start:stop] == PASSAGE and kept == (2,)
    out = {r.doc_id: (r.text, r.n_chars, r.start) for r in L.without_repeats(docs).collect()}
    assert out[4] == ("Own words of four.\nand some of  then more.", 42, "x")
    assert out[7][0] == "\nA tail."
    assert out[1][0] == rows[3][1] and out[3][0] is None and out[5][0] == "" and out[None][0] == PASSAGE


def test_short_repeats_stay(spark):
    rows = [(i, f"A common header line.\nText number {i} goes its own way.\nLicensed under some licence.") for i in range(30)]
    assert spans(frame(spark, rows)) == {}


def test_repeats_within_a_document_and_repeated_rows(spark):
    text = f"{PASSAGE}\nBetween them.\n{PASSAGE}"
    found = spans(frame(spark, [(1, text), (1, text), (2, "x" * 50000)]))
    assert set(found) == {1} and text[found[1][0] : found[1][1]] == PASSAGE
    assert found[1][0] > 0


def test_empty_table(spark):
    docs = frame(spark, [(1, "a")]).limit(0)
    assert spans(docs) == {} and L.without_repeats(docs).count() == 0


def test_spans_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    first, want = {}, {}
    for d, t in rows:
        stretch = []
        for n, (start, stop, words, digest) in enumerate(L.units_of(t or "")):
            if digest in first:
                if stretch and stretch[-1][0] == n - 1:
                    stretch.append((n, start, stop, words))
                else:
                    stretch = [(n, start, stop, words)]
                    want.setdefault(d, []).append(stretch)
            first.setdefault(digest, d)
    flat = sorted((d, s[0][1], s[-1][2], sum(x[3] for x in s)) for d, ss in want.items() for s in ss if sum(x[3] for x in s) >= 40)
    got = sorted((r.doc_id, r.start, r.stop, r.words) for r in L.repeated_spans(docs).collect())
    assert got == flat


def test_passage_without_marks_at_its_edges(spark):
    words = [f"word{i * i % 997}" for i in range(59)]
    shared = " ".join(words)
    rows = [(1, f"here the own text of one {shared} goes on and on"), (2, f"Some other beginning with {shared.upper()} ends."), (3, f"before {' '.join(words[:39])} and after")]
    found = {r.doc_id: r for r in L.shared_passages(frame(spark, rows)).collect()}
    assert set(found) == {2}
    assert rows[1][1][found[2].start : found[2].stop] == shared.upper() and (found[2].words, found[2].kept_in) == (59, [1])
    out = {r.doc_id: r.text for r in L.without_repeats(frame(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "Some other beginning with  ends.", 3: rows[2][1]}


def test_passages_of_any_place_and_of_a_script_without_blanks(spark):
    import random

    rng = random.Random(4)
    rows, want = [], {}
    for k in range(40):
        shared = " ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(40 + k % 5))
        if k % 4 == 0:
            shared = "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(45))
        own = lambda: " ".join(f"q{rng.randrange(10**9)}" for _ in range(rng.randrange(1, 90)))  # noqa: E731, B023
        rows += [(2 * k, f"{own()} {shared} {own()}"), (2 * k + 1, f"{own()} {shared} {own()}")]
        want[2 * k + 1] = shared
    found = {r.doc_id: rows[r.doc_id][1][r.start : r.stop] for r in L.shared_passages(frame(spark, rows)).collect()}
    assert found == want


def test_texts_that_share_a_doc_id_are_apart(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    other = " ".join(f"own{i}" for i in range(200))
    docs = frame(spark, [(1, "one " + passage), (2, "two " + passage), (2, other), (3, passage), (3, passage + " three")])
    cut = sorted((r.doc_id, r.text) for r in L.without_repeats(docs).collect())
    assert cut == [(1, "one " + passage), (2, other), (2, "two "), (3, ""), (3, " three")]
    found = sorted((r.doc_id, r.words, r.kept_in) for r in L.shared_passages(docs).collect())
    assert found == [(2, 60, [1]), (3, 60, [1])]
