import base64
import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

repeats = pytest.importorskip("weftmill.llm.repeats")
from weftmill.llm import mainbody, mixture, ocr, residue, skeleton, tokens  # noqa: E402

PATH = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"


def test_transducer_against_the_public_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    want = tiktoken.Encoding("own", pat_str=tokens.PIECES, mergeable_ranks=ranks, special_tokens={})
    m, rnd = tokens.merges(PATH), random.Random(11)
    for _ in range(400):
        kind = rnd.choice(["ab", "a", "=-", "the an", "ré日", "0123", "xyz_QRS"])
        s = "".join(rnd.choice(kind) for _ in range(rnd.choice([3, 10, 40, 300, 900])))
        t, data, out, i = tokens.Transducer(m), s.replace(" ", "").encode(), [], 0
        while i < len(data):
            n = rnd.randint(1, 70)
            out += t.feed(data[i : i + n])
            i += n
        out += t.end()
        assert out == m.merged(data)
        assert list(tokens.Encoder(m).blocks(s, size=rnd.choice([97, 500]))) == want.encode_ordinary(s)


def test_pairs_of_tokens_are_told_by_undoing_merges():
    m, rnd = tokens.merges(PATH), random.Random(3)
    for _ in range(3000):
        a, b = rnd.randrange(len(m.bytes)), rnd.randrange(len(m.bytes))
        assert m.compatible(a, b) == (m.merged(m.bytes[a] + m.bytes[b]) == [a, b])


@pytest.mark.parametrize("text", [
    "The null hypothesis was rejected.", "Chapter XX", "[Applause] Thank you all.", "The matrix had no NaN entries.", "A long text about birds in the wood.\nWelcome\nMore about birds and trees.", "Warning. Do not touch the wet paint on the fence today.",
    "If the pointer is null, the program stops.", "Louis XX of France came to the city in the spring.",
])
def test_what_only_resembles_residue(text):
    assert residue.Matcher().residue(text) == []


@pytest.mark.parametrize("text,kind", [("Loading...", "error"), ("Dear null, your form for null has come.", "placeholder"), ("Venue: [Course].", "placeholder"), ("We met at 5. Your text goes here. Then we left for the long way home over the hills.", "filler")])
def test_residue_of_a_part_and_of_a_whole(text, kind):
    assert [x[0] for x in residue.Matcher().residue(text)][:1] == [kind]


def _page(text: str, **counts: int) -> ocr.Page:
    words = {"the": 9000, "committee": 400, "met": 500, "in": 4000, "hall": 300, "first": 300, "year": 300, "students": 300, "water": 300, "and": 5000} | counts
    return ocr.Page(text, None, None, ocr.Lexicon(words, {}, 100_000))


def test_readings_of_a_stretch_compete():
    assert _page("the com mit tee met in the hall").repaired() == "the committee met in the hall"  # two gaps
    assert _page("the com-\nmit tee met in the hall").repaired() == "the committee met in the hall"  # a hyphen and a gap
    assert _page("thefirstyear students met in the hall").repaired() == "the first year students met in the hall"  # three run together
    p = _page("the comrnit-\ntee met in the hall")
    assert p.repaired() == "the committee met in the hall" or p.kinds  # a confusion beside a hyphen
    assert _page("the first-\nyear students met").repaired() == "the first-year students met"
    # a rarer reading does not win over a common word
    assert _page("the hall met", ha11=1).repaired() == "the hall met"


def test_rare_words_are_counted_exactly(spark):
    """With a share so large that no word is common, all are looked up by joins; results are the same."""
    base = "The warden met the students of the hostel and the committee in the main hall. "
    rows = [(i, base * 3, "t", "https://a/x.pdf") for i in range(30)] + [(99, base.replace("hostel", "hoste1").replace("committee", "com-\nmittee"), "t", "https://a/y.pdf")]
    d = spark.createDataFrame(rows, "file_id long, text string, title string, url string")
    got = [sorted(map(tuple, ocr.noise(d, share).filter("file_id = 99").collect())) for share in (ocr.SHARE, 0.5)]
    assert got[0] == got[1] == [(99, 0, "hyphen"), (99, 0, "misread")]


def test_parts_that_are_counted_themselves_are_read_over_gaps_and_cut(spark):
    """Parts and stretches have counts from the text they stand in, which must not keep them as they are."""
    base = "The first year of the warden and the committee began in the main hall. "
    rows = [(i, base * 3, "t", "https://a/x.pdf") for i in range(80)]
    rows += [(97, "The com mit-\ntee began in the hall.", "t", "https://a/v.pdf"), (98, "The warden and the com mit tee began in the hall.", "t", "https://a/y.pdf"), (99, "Thefirstyear of the warden began in the main hall.", "t", "https://a/z.pdf")]
    d = spark.createDataFrame(rows, "file_id long, text string, title string, url string")
    out = {r.file_id: r.repaired for r in ocr.repaired(d).filter("file_id > 90 or file_id = 0").collect()}
    assert out[97] == "The committee began in the hall."
    assert out[98] == "The warden and the committee began in the hall."
    assert out[99] == "The first year of the warden began in the main hall."
    assert out[0] == (base * 3).strip()
    assert sorted(map(tuple, ocr.noise(d).filter("file_id > 90").collect())) == [(97, 0, "hyphen")]


def test_batches_are_read_a_few_rows_at_a_time():
    """A batch of 4,000 texts, of 300 different words each, whose counts would be more than 100 MB at once."""
    rnd = random.Random(2)
    batch = pa.array([" ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(300)) for _ in range(4000)])
    tracemalloc.start()
    try:
        assert sum(len(part) for part in ocr._words.func(iter([batch]))) == 4000
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("most", [1, 7])
def test_hot_lines_are_parted_by_the_lines_that_follow(spark, monkeypatch, most):
    rnd = random.Random(9)
    runs = [[f"{w} {chr(97 + i)}" for i in range(n)] for w, n in (("menu", 4), ("foot", 3), ("side", 5))]
    rows = []
    for i in range(50):
        lines = [x for r in rnd.sample(runs, 3) for x in [*r[rnd.choice([0, 0, 1]) :], *rnd.choice([[], [f"own {i}x{chr(97 + i % 26)}{i // 26 * 'q'}"]])]]
        rows.append((i, f"https://x/{i}", "s", "\n".join(lines)))
    d = spark.createDataFrame(rows, "page_id long, url string, site string, text string")
    want = sorted(map(tuple, repeats.maximal_blocks(d, ["text"]).collect()))
    lines = sorted(map(tuple, repeats.repeated_lines(d, ["text"]).collect()))
    monkeypatch.setattr(repeats, "SORTED", most)
    assert sorted(map(tuple, repeats.maximal_blocks(d, ["text"]).collect())) == want and len(want) > 5
    assert sorted(map(tuple, repeats.repeated_lines(d, ["text"]).collect())) == lines


def test_many_copies_and_one_lookalike(spark):
    d = spark.range(30_000).select("id", F.when(F.col("id") == 17, "sсhool").otherwise("school").alias("text"))
    began = time.time()
    assert skeleton.lookalike_pairs(d).count() == 29_999
    assert time.time() - began < 60


def test_lines_take_their_ratio_from_what_they_belong_to():
    nos, rows, near, up, down, title = mainbody.page_lines("# T\n## Part\nA long first sentence of the page stands here. And another one.\n- item one\n- item two\n\nMenu\n- Home", "T")
    assert (nos, title) == ([0, 1, 2, 3, 4, 6, 7], 0) and near == [2, 2, -1, 2, 2, -1, 5]
    ratios = [10.0, 100.0, 1000.0, 5.0, 0, 0, 20.0, 0, 0]
    codes = [3 * r[0] + r[1] + (9 if k == title else 0) for k, r in enumerate(rows)]
    got = mainbody.line_ratios(codes, [True] * 7, near, up, down, ratios)
    assert got == [502.5, 502.5, 1000.0, 510.0, 510.0, 10.0, 15.0]
    assert mainbody.line_ratios(codes, [True, True, False, True, True, True, True], near, up, down, ratios)[2:5] == [0.0, 10.0, 10.0]


def test_epochs_have_orders_of_their_own(spark):
    d = spark.createDataFrame([(i, "word " * 20, "en", "a") for i in range(200)], "doc_id long, text string, lang string, source string")
    t = spark.createDataFrame([("a", 1.0, 9)], "source string, target_share double, max_repeats int")
    size = d.count() * 20
    extra = lambda total: {r.doc_id for r in mixture.mixture(d, t, total=total)[0].groupBy("doc_id").agg(F.max("repeats").alias("n")).collect() if r.n == max(1, total // size + 1)}
    first, second = extra(size * 0.3), {r.doc_id for r in mixture.mixture(d, t, total=size * 1.3)[0].filter("repeats = 2").collect()}
    assert first and second and first != second
