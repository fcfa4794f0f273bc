import random
import unicodedata

import pytest
from pyspark.sql import functions as F

language = pytest.importorskip("weftmill.llm.language")
from weftmill.llm import mainbody, mixture, ocr, queries, repeats, residue, skeleton, split, tokens  # noqa: E402

PAGE = """Home | About us | Library | Contact
You are here: Home > Notices
Posted by Web Team on 3 May 2024 · 4 min read

# Fees for 2025
The fee for the course is paid in two parts before the term begins. Late payment costs a fine of ten rupees a day.
- B.Com: 40 seats; waiting list: 3

## Who may apply
Copyright in the study notes rests with Dr. Rao and the department. Cookies are baked in the workshop on Friday at noon.

### Related links
» Merit list of May (3.5.2024)
- Handbook of the college ...
View all

Share this with your classmates: Mail · Chat · Print
All rights reserved by Hill College.
12 Long Road, Old Nagar
Phone: +91 0000 123456 | office@hill.example
We use cookies to count visits; read more in the data notice."""


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, site string, title string, text string, lang string")


def test_template_lines(spark):
    got = {r.line_no for r in mainbody.template_lines(_pages(spark, [(1, "https://hill.example/a", "hill.example", "Fees for 2025", PAGE, "en")])).collect()}
    assert got == {0, 1, 2, 11, 12, 13, 14, 16, 17, 18, 19, 20}


def test_main_body_of_odd_pages(spark):
    rows = [(1, None, None, None, None, None), (2, "u", "s", None, "", None), (3, "u", "s", "T", "\n\n", None), (4, "u", "s", None, "Home\nContact", None), (5, "u", "s", "T", PAGE, None), (5, "u", "s", "T", PAGE, None)]
    got = mainbody.main_body(_pages(spark, rows)).collect()
    by = {r.page_id: r.body for r in got}
    assert by[1] is None and by[2] == "" and by[3] == "" and by[4] == "" and by[5].startswith("# Fees") and "Phone" not in by[5]
    assert len(got) == 6 and mainbody.template_lines(_pages(spark, [])).count() == 0


def test_a_paragraph_on_many_pages_of_a_site_is_template(spark):
    same = "Our school was founded long ago by three friends who loved books and wanted a quiet place to read them."
    rows = [(i, f"https://a.example/{i}", "a.example", "T", f"{same}\nPage {chr(97 + i)} has words of its own that no other page of this site repeats, whatever they may be.", "en") for i in range(20)]
    got = {(r.page_id, r.line_no) for r in mainbody.template_lines(_pages(spark, rows)).collect()}
    assert got == {(i, 0) for i in range(20)}


SAMPLES = [("en", "the students of the college must pay the fee before the examination begins in the main hall " * 3), ("fr", "les étudiants du collège doivent payer les frais avant le début des examens dans la grande salle " * 3), ("hi", "महाविद्यालय के छात्रों को परीक्षा से पहले शुल्क जमा करना होगा " * 3), ("mr", "महाविद्यालयाच्या विद्यार्थ्यांनी परीक्षेपूर्वी शुल्क भरणे आवश्यक आहे " * 3), ("hi", "mahavidyalaya ke chhatron ko pariksha se pehle shulk jama karna hoga " * 3)]
LINES = {"en": "The students must pay the fee before the examination begins.", "fr": "Les étudiants doivent payer les frais avant le début des examens.", "hi": "छात्रों को परीक्षा से पहले शुल्क जमा करना होगा और आना होगा।", "mr": "विद्यार्थ्यांनी परीक्षेपूर्वी शुल्क भरणे आवश्यक आहे आणि यावे असे आहे."}


@pytest.mark.parametrize("lang", sorted(LINES))
def test_languages(lang):
    got, confidence = language.Languages(SAMPLES).of(LINES[lang])
    assert got == lang and 0 < confidence <= 1


def test_latin_hindi_and_nothing():
    ls = language.Languages(SAMPLES)
    assert ls.of("chhatron ko pariksha se pehle shulk jama karna hoga")[0] == "hi"
    assert ls.of("12345 --")[0] is None and ls.of("")[0] is None and language.Languages([]).of("text")[0] is None


@pytest.mark.parametrize("label,want", [("en", "en"), ("en_US", "en"), ("ENG", "en"), ("English", "en"), ("hi-IN", "hi"), ("xx", None), (" ", None), (None, None), ("-", None), ("fre", "fr")])
def test_labels(spark, label, want):
    assert language.named(label) == want
    assert spark.createDataFrame([(label,)], "l string").select(language._named_column(F.col("l"))).first()[0] == want


def test_segments_of_pages(spark):
    text = "\n".join(["# Heading of some words that is no prose line at all", LINES["en"], LINES["en"], "- item", LINES["fr"], LINES["en"]])
    rows = [(1, "u1", "s", "T", text, "eng"), (2, "u2", "s", "T", LINES["fr"], "en"), (3, "u3", "s", "T", LINES["fr"], "French"), (4, "u4", "s", "T", None, None), (5, "u5", "s", "T", "short line", "en")]
    samples = spark.createDataFrame([(i, *x) for i, x in enumerate(SAMPLES)], "sample_id long, lang string, text string")
    got = language.corrections(language.labelled_segments(_pages(spark, rows), samples))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "en"), (1, 2, "fr"), (1, 3, "en"), (2, 0, "fr")]


def _brute_lines(rows, min_urls=6, share=0.15):
    urls, on = {}, {}
    for key, url, site, text in rows:
        urls.setdefault(site, set()).add(url)
        for i, line in enumerate((text or "").split("\n")):
            k = repeats.line_key(line)
            if k:
                on.setdefault((site, k), set()).add(url)
    return sorted((key, "text", i) for key, url, site, text in rows if text for i, line in enumerate(text.split("\n")) if (k := repeats.line_key(line)) and len(on[site, k]) >= min_urls and len(on[site, k]) >= share * len(urls[site]))


def test_repeated_lines_against_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(120):
        lines = [rnd.choice(["All rights reserved 2024", "ALL RIGHTS  reserved, 2025", "Сontact us", "Contact us", "12 34", "", f"line {rnd.choice('abcdefghij') * 3}", "é", "é"]) for _ in range(6)]
        rows.append((i, f"https://x/{rnd.randint(0, 60)}", rnd.choice(["a", "a", "a", "b"]), rnd.choice(["\n".join(lines)] * 9 + [None])))
    d = spark.createDataFrame(rows, "page_id long, url string, site string, text string")
    assert sorted(map(tuple, repeats.repeated_lines(d, ["text"]).collect())) == _brute_lines(rows)


def test_blocks_are_repeated_runs_of_lines(spark):
    block = "first line\nsecond line\nthird line\nfourth line"
    rows = [(i, f"https://x/{i}", "a", f"own {chr(97 + i)}\n{block}\nend {chr(97 + i)}") for i in range(12)]
    d = spark.createDataFrame(rows, "page_id long, url string, site string, text string")
    assert [(r.length, r.pages, r.places) for r in repeats.maximal_blocks(d, ["text"]).collect()] == [(4, 12, 12)]
    left = repeats.without_lines(d, repeats.repeated_lines(d, ["text"]), ["text"]).orderBy("page_id").first()
    assert left.text == "own a\nend a"


def _brute_blocks(rows, min_urls=6, share=0.15):
    urls, at = {}, {}
    for key, url, site, text in rows:
        urls.setdefault(site, set()).add(url)
        ks = [k for k in map(repeats.line_key, (text or "").split("\n")) if k]
        for i in range(len(ks)):
            for j in range(i + 1, len(ks) + 1):
                at.setdefault((site, *ks[i:j]), []).append((url, key, ks[i - 1] if i else None, ks[j] if j < len(ks) else None))
    out = []
    for (site, *block), places in at.items():
        if len({p[0] for p in places}) >= max(min_urls, share * len(urls[site])) and not any(len({p[c] for p in places}) == 1 and places[0][c] for c in (2, 3)):
            out.append((site, len(block), len({p[1] for p in places}), len(places)))
    return sorted(out)


def test_maximal_blocks_of_any_length_against_brute_force(spark):
    rnd = random.Random(5)
    runs = [[f"{w} {chr(97 + i)}" for i in range(n)] for w, n in (("menu", 3), ("foot", 5), ("side", 6), ("top", 7), ("end", 9))]
    rows = []
    for i in range(60):
        lines = [x for r in rnd.sample(runs, 3) for x in [f"own {chr(97 + i % 26) * (i // 26 + 1)}", *r[: rnd.choice([len(r)] * 3 + [2])], *rnd.choice([[], ["", "12"], ["loop", "loop", "loop"]])]]
        rows.append((i, f"https://x/{i % 55}", "ab"[i % 5 == 0], "\n".join(lines)))
    want = _brute_blocks(rows)
    assert {3, 5, 6, 7, 9} <= {r[1] for r in want}
    d = spark.createDataFrame(rows, "page_id long, url string, site string, text string")
    assert sorted((r.site, r.length, r.pages, r.places) for r in repeats.maximal_blocks(d, ["text"]).collect()) == want
    assert repeats.maximal_blocks(d.limit(0), ["text"]).count() == 0


def test_repeats_of_nothing(spark):
    d = spark.createDataFrame([(1, None, None, None)], "page_id long, url string, site string, text string")
    assert repeats.repeated_lines(d, ["text"]).count() == 0 and repeats.repeated_lines(d.limit(0), ["text"]).count() == 0


def test_pieces():
    rnd = random.Random(3)
    texts = ["", "short", "word " * 3000, "x" * 5000, "नमस्ते " * 2000, "é" * 4000, "\n\n".join("A sentence stands here. Another one follows it." * rnd.randint(1, 30) for _ in range(40))]
    for t in texts:
        got = split.pieces(t)
        assert "".join(t[s:e] for _, s, e in got) == t
        for k, (f, s, e) in enumerate(got):
            assert (len(t[f:e]) + sum(c > "\x7f" for c in t[f:e])) // 4 + 1 <= 350
            assert f == s if k == 0 else (len(t[f:s]) + sum(c > "\x7f" for c in t[f:s])) // 4 + 1 <= 50 and f >= got[k - 1][1]
            assert s == 0 or unicodedata.category(t[s])[0] != "M"
    assert len(split.pieces("word " * 3000)) > 10


def test_split_rows(spark):
    rows = [(1, None), (2, ""), (3, "small"), (4, "One sentence is here. " * 200), (4, "One sentence is here. " * 200)]
    d = spark.createDataFrame(rows, "chunk_id long, text string").withColumn("piece", F.lit("clash"))
    got = split.split_oversized(d).collect()
    assert {(r.chunk_id, r.piece_text) for r in got if r.chunk_id < 4} == {(1, None), (2, ""), (3, "small")}
    big = [r for r in got if r.chunk_id == 4]
    assert len(big) == 2 * big[0].n_pieces and max(r.piece_tokens for r in big) <= 350 and all(r.piece_text.startswith("One") for r in big)


@pytest.mark.parametrize("a,b,same", [
    ("Hello World", "Ｈｅｌｌｏ　Ｗｏｒｌｄ", True), ("paper", "рареr", True), ("café", "café", True), ("re​ad", "read", True), ("a b", "a b", True), ("office", "oﬃce", True), ("post-war", "post‐war", True),
    ("café", "cafe", False), ("x²", "x2", False), ("½", "1/2", False), ("10", "11", False), ("a\nb", "a b", False), ("", "", True),
])
def test_skeletons(a, b, same):
    assert (skeleton.skeleton(a) == skeleton.skeleton(b)) == same


def test_lookalike_pairs(spark):
    rows = [(1, "paper"), (2, "рареr"), (3, "paper"), (4, "Ｐaper"), (5, None), (6, ""), (7, "​"), (8, "paрer")]
    got = sorted(map(tuple, skeleton.lookalike_pairs(spark.createDataFrame(rows, "id long, text string")).collect()))
    assert got == [(1, 2), (1, 8), (2, 3), (2, 8), (3, 8)]
    assert skeleton.lookalike_pairs(spark.createDataFrame([], "id long, text string")).count() == 0


SCAN = """The committee of the hos-
tel met in the main hall. The report was re@d by the
warden of the first-
year students and the com-
Hill College    12
mittee closed the rneeting.

Page 13 of 20
The next meeting of the committee is in the main hall."""


def test_noise_of_scans(spark):
    clean = "The committee of the hostel met in the main hall. The report was read by the warden of the first-year students. The committee closed the meeting. The first-year students met. "
    rows = [(i, clean * 3, f"T {i}", f"https://a/{i}.pdf") for i in range(10)] + [(99, SCAN, "Minutes", "https://a/m-1.pdf"), (100, None, None, None), (101, "", None, None)]
    d = spark.createDataFrame(rows, "file_id long, text string, title string, url string")
    got = {(r.line_no, r.kind) for r in ocr.noise(d).filter("file_id = 99").collect()}
    assert got == {(0, "hyphen"), (1, "misread"), (3, "hyphen"), (4, "header"), (5, "misread"), (7, "page_number")}
    out = {r.file_id: r.repaired for r in ocr.repaired(d).collect()}
    assert out[99] == "The committee of the hostel met in the main hall. The report was read by the warden of the first-year students and the committee closed the meeting.\n\nThe next meeting of the committee is in the main hall."
    assert out[100] is None and out[101] == "" and ocr.noise(d).filter("file_id < 99").count() == 0


def _tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizers_own():
    t, m = _tokenizer(), tokens.merges(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
    e, rnd = tokens.Encoder(m), random.Random(5)
    parts = ["a", "ab", "the ", " ", "  ", "é", "नमस्ते", "\n", "'s", "'ll", "1", "22", "!", "...", "<|endoftext|>", "\t", "👩‍🎓", "don't", "x" * 90, " " * 70]
    for _ in range(150):
        text = "".join(rnd.choice(parts) for _ in range(120))
        want = t.encode(text, add_special_tokens=False).ids
        assert e.ids(text) == want
        for size in (64, 101):
            assert list(e.blocks(text, size)) == want
        d = tokens.Decoder(m)
        assert "".join([*map(d.feed, want), d.end()]) == text


def test_transducer_holds_little():
    m = tokens.merges(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
    t, out, most = tokens.Transducer(m), [], 0
    for _ in range(60):
        out += t.feed(b"abcdefgh" * 40)
        most = max(most, len(t.last))
    out += t.end()
    assert most <= 4 * m.lookahead and b"".join(m.bytes[i] for i in out) == b"abcdefgh" * 2400


def test_ids_of_null_and_empty(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "hi"), (3, "hi")], "doc_id long, text string")
    got = [(r.doc_id, r.ids) for r in tokens.encoded(d).orderBy("doc_id").collect()]
    assert got == [(1, []), (2, []), (3, [5303]), (3, [5303])]


def test_budgets_go_to_siblings_first():
    leaves = [{"name": "a", "path": ("x",), "weight": 0.4, "capacity": 10.0}, {"name": "b", "path": ("x",), "weight": 0.2, "capacity": 1000.0}, {"name": "c", "path": ("y",), "weight": 0.4, "capacity": 1000.0}]
    got = mixture.budgets(leaves, 100)
    assert got["a"] == 10 and abs(got["b"] - 50) < 1e-6 and abs(got["c"] - 40) < 1e-6
    leaves[1]["capacity"] = 20.0
    got = mixture.budgets(leaves, 100)
    assert got["b"] == 20 and abs(got["c"] - 70) < 1e-6
    assert mixture.budgets([], 5) == {}


def test_mixture_meets_shares_and_repeats(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(["word"] * rnd.randint(1, 9)), "en", rnd.choice(["big"] * 20 + ["small"] * 3 + ["other"])) for i in range(3000)] + [(9001, None, "en", "big"), (9002, "", None, "small"), (9003, "x", "en", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    t = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 5), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed, report = mixture.mixture(d, t)
    shares = {r.source: r.actual_share for r in report.collect()}
    assert abs(shares["big"] - 0.5 / 0.9) < 0.01 and abs(shares["small"] - 0.4 / 0.9) < 0.01 and shares["gone"] == 0
    most = {r.source: r.m for r in mixed.groupBy("source").agg(F.max("repeats").alias("m")).collect()}
    assert most["big"] <= 2 and most["small"] <= 5 and mixed.groupBy("doc_id").count().filter("count > 1").count() == 0
    again = mixture.mixture(d.repartition(7), t)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))
    assert mixture.mixture(d.limit(0), t)[0].count() == 0


@pytest.mark.parametrize("text,kind", [
    ("Dear {{ name }}, your seat is {{ seat }}.", "placeholder"), ("Venue: XXXX.", "placeholder"), ("Hello %NAME%!", "placeholder"), ("Speaker: [Student Name].", "placeholder"), ("Time: undefined.", "placeholder"),
    ("404 - Page not found.", "error"), ("Please enable JavaScript to view this page.", "script"), ("SEITE NICHT GEFUNDEN.", "error"), ("Your text goes here.", "filler"), ("Lorem ipsum dolor sit amet elit sed.", "filler"),
    ("The word undefined in mathematics means that no value can be given.", None), ("The lesson on templates shows how {{ name }} is replaced by a value before the page is sent.", None), ("Students learn why a server answers 404 Not Found and how a helpful page is written.", None),
    ("Name: ________ Roll no.: ______", None), ("A set such as {a, b, c} has eight subsets.", None), ("<|endoftext|> <s>[INST]</s>", None), ("", None), ("  ", None),
])
def test_residue(text, kind):
    got = residue.Matcher().residue(text)
    assert (got[0][0] if got else None) == kind


def test_without_residue(spark):
    d = spark.createDataFrame([(1, "Good text of a page."), (2, "Page not found."), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in residue.without_residue(d).collect()) == [1, 3, 4]


def test_every_query_runs_on_empty_and_small_tables(spark):
    assert set(queries.SQL) <= set(queries.QUERIES)
    for n in (1, 2, 4, 5, 6, 7, 10):
        assert f"p{n}_found" in queries.QUERIES
