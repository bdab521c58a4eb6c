"""Charset repair, residue, boilerplate and truncation on small inputs and held-out pages."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.llm import boilerplate, charset, residue, truncation
from webloom.llm.page import parse
from webloom.runtime import table

SF = "/root/testdata/sf0.01"
SOUND = ["fiancé’s menu", "NÃO e SÃO: ATENÇÃO", "Größe „Möbel“", "Bake at 180 °C with ½ cup and 3×5 cm", "±67 → 5", "Ещё запрещён защищены", "нАША почтальонша", "КОНТАКТЫ (0)", "日本語のテキスト。", "Salt &amp; pepper &lt;b&gt;", "naïve 'quotes' – dash — €5",
         "τα δε σε και η Ελλάδα ΑΘΗΝΑ", "ÄÖÜ äöü", "鰯と鯖の味噌煮", "我的朋友", "한국어 문장입니다", "שלום עולם", "قهوة", "Dvořák Łódź İstanbul"]


@pytest.mark.parametrize("text", SOUND)
def test_sound_text_stays(text):
    assert charset.garbled_tokens(text) == {} and charset.restore(text) == text


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252", "cp1251", "mac-roman", "cp437"])
def test_misread_utf8_round_trip(encoding):
    for text in ("the café’s señor Zürich-style crème", "Größere Körbe kosten müde"):
        raw = text.encode()
        bad = "".join(charset._CHARS[encoding].get(b, chr(b)) if b > 127 else chr(b) for b in raw)
        assert charset.restore(bad) == text


def test_other_misreadings():
    twice = "the soufflé touch".encode().decode("cp1252").encode().decode("cp1252")
    assert charset.restore(twice) == "the soufflé touch"
    assert charset.restore("Наша учительница открыла".encode("koi8-r").decode("cp1251")).startswith("Наша")
    assert charset.restore("Говорят вечером".encode("cp1251").decode("latin-1")) == "Говорят вечером"
    assert charset.restore("fa&Atilde;&sect;ade") == "façade"
    assert charset.garbled_tokens("fa��ade") == {"fa��ade": "fa��ade"}


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252", "cp1251", "koi8-r", "iso8859-5"])
def test_blanks_that_are_bytes_of_misread_text(encoding):
    for text in ("voilà là-bas", "Работа Россия хорошо их Конец"):
        bad = "".join(charset._CHARS[encoding].get(b, chr(b)) for b in text.encode())
        assert charset.restore(bad) == text
    assert charset.garbled_tokens("voilÃ\xa0") == {"voilÃ\xa0": "voilà"} and charset.restore("Ã\xa0 la") == "à la" and charset.restore("10Â\xa0km") == "10\xa0km"
    for text in ("AMANHÃ\xa0 DE", "À\xa0propos de l'été\xa0: «\xa0oui\xa0»", "В\xa0Москве и\xa0в\xa0этом\xa0году", "Größe\xa0und\xa0Maß"):
        assert charset.garbled_tokens(text) == {}


@pytest.mark.parametrize(("text", "charset_"), [("我的朋友", "gb18030"), ("こんにちは", "cp932"), ("ελληνικά", "cp1253"), ("Dvořák", "cp1250"), ("İstanbul", "cp1254")])
def test_misread_utf8_of_other_scripts(text, charset_):
    bad = text.encode().decode(charset_)
    assert charset.restore(bad) == text and charset.garbled_tokens(bad) == {bad: text}


def test_the_bound_of_the_search_loses_nothing_here():
    words = ["soufflé", "Größe", "учительница", "ελληνικά", "日本語", "crème", "señor"]
    pairs = [("latin-1", 1), ("cp1251", 1), ("cp437", 1), ("mac-roman", 2), ("cp1252", 2)]
    for w in words:
        for cs, times in pairs:
            bad = w
            for _ in range(times):
                bad = "".join(charset._CHARS[cs].get(b, chr(b)) if b > 127 else chr(b) for b in bad.encode())
            assert charset.search(bad)[:2] == charset.search(bad, limit=None)[:2], (w, cs)


def test_quoted_samples_do_not_count(spark):
    rows = [(1, b"<p><code>caf\xc3\x83\xc2\xa9</code></p>"), (2, "text\n    cafÃ© → café\nmore".encode()), (3, "cafÃ©".encode()), (4, None), (5, b""), (6, ("x " * 200_000 + "cafÃ©").encode())]
    df = spark.createDataFrame(rows, "response_id long, body binary").withColumn("record_id", F.lit(9))
    assert sorted(r.record_id for r in charset.garbled(df, "response_id", "body").collect()) == [3, 6]
    assert {r.record_id: r.text for r in charset.garbled(df.filter("response_id = 3"), "response_id", "body", True).collect()} == {3: "café"}
    assert charset.garbled(df.limit(0), "response_id", "body").count() == 0


def test_leaf_blocks():
    p = parse("<html><head><title>A &amp; b</title><style>x{}</style></head><body>\n<!-- c\nd -->\n<div class=\"post big1\"><h1>H</h1>\n<p>one <a href='x'>two</a>\n</div>\n<pre><code>a < b</code></pre>\n")
    assert p.title == "A & b" and [(x.at, x.text) for x in p.blocks] == [((4,), "H"), ((5,), "one two"), ((7,), "a < b")]
    assert "post" in p.blocks[0].around and p.blocks[2].code and p.blocks[2].bare == "" and 0 < p.blocks[1].linked < 1
    assert [(x.at, x.code) for x in parse("a\n\n    b").blocks] == [((1,), False), ((3,), True)]
    assert parse("").blocks == [] and parse('{"a": 1}').kind == "json"
    one = parse("<body><nav><a>x</a> <a>y</a></nav><p>first<p>second <code>{{c}}</code> {{d}}<br>third<script>if (a < b) {}</script></body>")
    assert [(x.at, x.text, x.bare) for x in one.blocks] == [((1,), "x y", "x y"), ((1,), "first", "first"), ((1,), "second {{c}} {{d}}", "second  {{d}}"), ((1,), "third", "third")]
    assert [x.at for x in parse("<p>a\n&nbsp;\n<b>b</b>\nc</p>\n<p title='x\ny'>d</p>").blocks] == [((1, 3, 4)), (6,)]
    assert [x.text for x in parse("<p>a <a title=\"it's>b</a> c<p>d").blocks] == ["a b c", "d"]


def test_residue_on_unseen_hosts(spark):
    v = {r.classifier: r for r in residue.validation(table(spark, "/root/testdata/sf0.1", "responses"), most=6000).collect()}
    for name in ("pages", "expressions"):
        assert v[name].precision > 0.9 and v[name].recall > 0.9, v[name]
    for name in ("pages unseen", "expressions unseen"):  # phrases and languages that labelled nothing
        assert v[name].positives and v[name].recall > 0.6, v[name]


def test_a_long_placeholder_is_found(spark):
    base = table(spark, SF, "responses").select("response_id", "url", "status", "body")
    good = "<html><body><p>" + "The mossy harbour near the old quay keeps jars. " * 40
    rows = [(30_000, None, 200, (good + "{{ " + "customer." * 15 + "name }}</p>").encode())]
    assert 30_000 in {r.response_id for r in residue.residue_pages(base.unionByName(spark.createDataFrame(rows, base.schema))).collect()}


def test_residue_cases(spark):
    good = "<html><body><p>" + "The mossy harbour near the old quay keeps jars. " * 40
    rows = [(10_001, None, None, None), (10_002, None, 200, b""), (10_003, None, None, (good + "Dear {{user.name}},</p>").encode()), (10_004, None, 200, (good + "<code>{{x}}</code> the set {a, b, c}</p>").encode()), (10_005, "u", 200, b"<p>404 Not Found</p><p>The requested URL was not found on this server.</p>")]
    base = table(spark, SF, "responses").select("response_id", "url", "status", "body")
    df = base.unionByName(spark.createDataFrame(rows, base.schema)).withColumn("host_key", F.lit(1))
    got = {r.response_id for r in residue.residue_pages(df).collect()}
    assert got & set(range(10_001, 10_006)) == {10_003, 10_005}
    assert residue.residue_pages(df.limit(0)).count() == 0


def test_error_statuses_teach_wordings_in_no_phrase_list(spark):
    base = table(spark, SF, "responses").select("response_id", "url", "status", "body")
    body = lambda n: f"<html><body><h1>Nie znaleziono strony</h1><p>Przepraszamy, adres {n} wygasł. Wróć na stronę główną serwisu.</p></body></html>".encode()
    sound = "<html><body><p>Between cove and jetty, Dartolpal counted 63 brittle barley stalls. Nobody borrowed the Zürich-style menu at Venor’s workshop since noon.</p></body></html>".encode()
    rows = [(20_000 + n, f"http://h{n}.test/", 404, body(n)) for n in range(12)] + [(21_000, "http://h.test/", None, body(99)), (21_001, "http://s.test/", 404, sound)]
    got = {r.response_id for r in residue.residue_pages(base.unionByName(spark.createDataFrame(rows, base.schema))).collect()}
    assert {*range(20_000, 20_012), 21_000} <= got and 21_001 not in got


def test_main_lines_on_unseen_hosts(spark):
    for r in boilerplate.validation(table(spark, SF, "responses")).collect():
        assert r.precision > 0.95 and r.recall > 0.95, r


def test_main_lines_cases(spark):
    base = table(spark, SF, "responses").select("response_id", "url", "status", "body")
    rows = [(10_001, None, None, None), (10_002, None, 200, b""), (10_003, None, 404, b"<p>404 Not Found</p><p>The requested URL was not found on this server.</p>")]
    df = base.unionByName(spark.createDataFrame(rows, base.schema)).withColumn("line_no", F.lit(1))
    got = boilerplate.main_lines(df).collect()
    assert {r.response_id for r in got} & {10_001, 10_002, 10_003} == set() and len(got) > 5000
    assert boilerplate.main_lines(df.limit(0)).count() == 0


def _one_line(body: str) -> bytes:
    return body.replace("\n", " ").encode()


def test_a_page_on_one_line_and_long_pages(spark, tmp_path):
    base = table(spark, SF, "responses").select("response_id", "url", "status", "body")
    model = boilerplate.fit(base)
    article = "".join(f"<p>The mossy harbour near the old quay keeps {n} jars. Nobody painted them since noon.</p>\n" for n in range(700))
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li>\n<li><a href='/s'>Search</a></li></ul></nav>\n<article><h1>Jars of the harbour</h1>\n{article}</article>\n<footer>© 2024 All rights reserved</footer></body></html>"
    rows = [(1, None, 200, page.encode()), (2, None, 200, _one_line(page))]
    df = spark.createDataFrame(rows, base.schema)
    got = {}
    for r in boilerplate.main_lines(df, model=model).collect():
        got.setdefault(r.response_id, set()).add(r.line_no)
    assert got[2] == {1} and got[1] >= set(range(3, 704)) and not got[1] & {1, 2, 704}
    known = boilerplate._Features(boilerplate._sums(model.crf.w))
    one = parse(_one_line(page).decode())
    (labels,) = boilerplate.label_pages(model.crf, [one], known)
    main = [x.text for x, y in zip(one.blocks, labels) if y]
    assert len(main) == 701 and main[0] == "Jars of the harbour"  # parts of one line are told apart
    # a long page teaches as well as a short one
    crf = boilerplate.fit(df, residue_rows=1).crf
    assert crf is not None and (crf.w != 0).any()
    model.save(spark, str(tmp_path / "model"))
    again = boilerplate.MainBodyModel.load(spark, str(tmp_path / "model"))
    assert {(r.response_id, r.line_no) for r in boilerplate.main_lines(df, model=again).collect()} == {(i, n) for i, ns in got.items() for n in ns}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, None, 200, "<p>The mossy harbour keeps jars.</p>".encode()), (2, None, 200, None)], "response_id long, url string, status int, body binary")
    with pytest.raises(Exception, match="declares its article"):
        boilerplate.main_lines(df).collect()
    assert boilerplate.main_lines(df.filter("response_id = 2")).count() == 0


def make_texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
    nouns, verbs = sorted({word() for _ in range(60)}), sorted({word() for _ in range(20)})
    sentence = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} near {rng.choice(nouns)}."
    docs, cut = [], set()
    for i in range(900):
        text = " ".join(sentence() for _ in range(rng.randrange(5, 40)))
        if i % 3 == 0 and len(text) > 600:
            text = text[:600]
        elif i % 7 == 0:
            text = text[: rng.randrange(150, 220)]
        elif i % 11 == 0:
            text += f"\n\nPhoto: Name{i}"
        if not text.endswith(".") and "Photo" not in text and not text.rstrip().endswith("."):
            cut.add(i)
        docs.append((i, text, "Web-Site " if i % 2 else "web_site"))
    return docs, cut


def test_truncation(spark):
    docs, cut = make_texts()
    docs += [(2000, None, "web_site"), (2001, "", "web_site"), (2002, "  ", None), (2003, "code:\n```\nyield x", "web_site")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("row", F.lit(1))
    got = {r.doc_id: r.reason for r in truncation.truncated(df).collect()}
    assert got.pop(2003) == "code"
    found = set(got)
    assert len(found & cut) / len(cut) > 0.97 and len(found - cut) / len(found) < 0.03
    assert sum(r == "limit" for r in got.values()) > 50
    shares = {r.source: r for r in truncation.truncation_shares(df).collect()}
    assert shares["web_site"].docs == 903 and shares[None].truncated == 0
    assert truncation.truncated(df.limit(0)).count() == 0


def test_limits_name_the_measure(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        t = "".join(rng.choice('ab "&\né') for _ in range(rng.randrange(200, 500)))
        if i % 3 == 0:  # stored in 256 bytes of JSON
            while len(t) + sum(c in '"\\\n' for c in t) > 256:
                t = t[:-1]
            t = t[:-1] + "b" if len(t) + sum(c in '"\\\n' for c in t) == 256 and t[-1] not in '"\n' else t
        rows.append(("s", t, False))
    got = truncation.storage_limits(spark.createDataFrame(rows, "source string, text string, ended boolean")).collect()
    assert [(r.measure, r.length) for r in got][:1] == [("json_chars", 256)]


def test_limit_and_open_code_come_before_customary_endings(spark):
    rng = random.Random(6)
    sentence = lambda: f"The {rng.choice(['mill', 'harbour', 'kiln', 'orchard'])} {rng.choice(['keeps', 'feeds', 'holds'])} the {rng.choice(['jars', 'nets', 'lamp oil'])}."
    docs = []
    for i in range(400):
        text = " ".join(sentence() for _ in range(rng.randrange(5, 18)))
        if i % 4 == 0:
            text += f"\n\nPhoto: Name{i}"  # the custom of the source
        elif i % 4 == 1:
            text = (" ".join([text] * 3))[:585] + "\n\nPhoto: Name"  # the same words, but cut there
            text += "x" * (600 - len(text))
        docs.append((i, text, "s"))
    docs.append((1000, "code:\n```\nyield x\n\nPhoto: Name7", "s"))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r.reason for r in truncation.truncated(df).collect()}
    assert got.pop(1000) == "code"
    assert got == {i: "limit" for i, t, _ in docs if len(t) == 600}


def test_limits_of_short_texts(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        t = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(4, 20)))
        rows.append(("cut", t[:60], False))
        rows.append(("form", f"Photo: Name{i:03}", False))  # one length by its form
        rows.append(("crowd", t[: max(8, round(rng.gauss(30, 2)))], False))  # many near one length
    got = truncation.storage_limits(spark.createDataFrame(rows, "source string, text string, ended boolean")).collect()
    assert [(r.source, r.measure, r.length) for r in got] == [("cut", "raw_chars", 60)]
