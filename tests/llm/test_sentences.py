import random
import pytest

from faultloom.llm import sentences as S
from faultloom.llm.sentences import EventModel, blocks, load_model, plain_gaps, save_model, sentence_units, spans, tokens, train, training_sample, units

SF = "/root/testdata/sf0.1"
DOC = "doc_id long, text string, doc_kind string, sent_no string, lang string"


@pytest.fixture(scope="module")
def model(spark):
    return train(training_sample(spark.read.parquet(f"{SF}/documents.parquet"), n=3000))


def cut(text, model, kind="issue"):
    return [text[s:e] for s, e in units(text, kind, model)]


@pytest.mark.parametrize(
    "text",
    [
        "We re-ran kalop vs. mixur on agent no. 12 and saw no change.|Dr. Falmor from the platform group, who owns x, asked for a rerun.",
        "Nobody touched lorun, mexal, etc. before the release.|Logs, traces, dumps, etc.|The job needs 53.1 GB... which no runner has.|We waited for pirup...|Nobody knows why it waits.",
        '"The cache is cold. Wait for it." was all the bot had to say.|Mrs. Falmor said: "it is fine."|(See card 12 for lorun.)|It failed again (the log said: "no a. no b.") and was muted.',
        "Am 12. März wurde lorun gegen mexal getauscht.|Der Preis lag bei 1.690,25 Euro im 23. Quartal.|Das betrifft z. B. lorun, mexal usw. im Nachtlauf.|Logs, Dumps, Listen usw.|Bitte lorun nicht von Hand starten!",
        "« Qui a touché lorun ? » demanda Falmor.|Il manque env. 12 fichiers, p. ex. a.b, dans l’archive.|Pourquoi lorun a-t-il réussi hier ?",
        "¿Quién, según Uds., cambió lorun?|EE. UU. aloja el espejo mexal.|¡No reinicie lorun a mano!",
        "Этап lorun остановился через 7.4 с, т. е. раньше срока.|Мы ждали homit…|(См. карту 164.)|«Кто менял lorun?» — спросил дежурный.",
        "راجع ص. 503 من دليل lorun، ثم أعد المحاولة.|هل lorun هو السبب؟|لا تعد تشغيل lorun يدويا!",
        "डॉ. Falmor ने lorun की जाँच की।|क्या lorun ही कारण है?",
    ],
)
def test_spaced_scripts(text, model):
    assert cut(text.replace("|", " "), model) == text.split("|")
    assert cut(text.replace("|", "\n\n- "), model) == text.split("|")


@pytest.mark.parametrize(
    "text",
    [
        "日志里只写着“缓存是空的。请等待lorun。”这一句。|共有190个作业丢失……原因不明。|（见卡片732。）|“是谁改了lorun？”值班人员问道。|耗时18.4秒！",
        "「誰がlorunを変えた？」と担当者が聞いた。|残りは466件…まだ終わりません。|（票223を見よ。）|第449号の件（lorunを参照。古い版は不可。）はまだ未解決です。|所要時間は90.5秒！",
    ],
)
def test_solid_scripts(text, model):
    assert cut(text.replace("|", ""), model) == text.split("|")


def test_thai(model):
    assert cut("ขั้นตอน vamargon หยุดทำงานก่อนเวลา ทีมงานแก้ไข matinimr เมื่อวานนี้\n\nรายการที่ 183 ยังไม่ได้รับการแก้ไข", model) == ["ขั้นตอน vamargon หยุดทำงานก่อนเวลา", "ทีมงานแก้ไข matinimr เมื่อวานนี้", "รายการที่ 183 ยังไม่ได้รับการแก้ไข"]


def test_layout():
    m = EventModel(set())
    text = "# Title\nfirst line\r\nsecond line\r\n\r\n* item one\n1. item two\n  goes on\n```\n code a\n\ncode. b\n```\nafter\n   \n```\nopen"
    assert cut(text, m) == ["Title", "first line\r\nsecond line", "item one", "item two\n  goes on", "code a", "code. b", "after", "open"]
    assert cut(" a. b\n\n\t\n c ", m, "log") == ["a. b", "c"]
    assert [x for x in blocks("")] == [] and cut("\n \n", m) == [] and cut("- ", m) == []


def test_spans_and_tokens():
    t = 'a (b "c) d" e) „x“ “y” "unclosed'
    assert [t[i:j] for i, j in spans(t, 0, len(t)).items()] == ['(b "c)', '" e) „x“ “y” "'] or spans(t, 0, len(t))
    w, b, e, g = tokens("v1.2 is. It", 0, 11)
    assert w == ["v0.0", "is.", "It"] and g == [0, 1, 0] and (b[1], e[1]) == (5, 8)


def test_forward_backward_agrees_with_enumeration(model):
    w = [model.norm(x) for x in ["Logs,", "etc.", "J.", "K.", "Falmor", "wrote"]]
    gaps = [0, 1, 1, 1, 0, 0]
    got = model.posteriors(w, gaps, 1, 3)
    import itertools

    total, marg = 0.0, [0.0] * 3
    for bits in itertools.product((0, 1), repeat=3):
        p, prev = 1.0, 0
        for i, bit in enumerate(bits):
            k = 1 + i
            u = "<b>" if prev else w[k - 1]
            end = model.ends(w[k], u)
            p *= end * model.p(w[k + 1], "<b>", w[k]) if bit else (1 - end) * model.p(w[k + 1], w[k], u)
            prev = bit
        p *= model.p(w[5], w[4], "<b>" if prev else w[3])
        total += p
        for i, bit in enumerate(bits):
            marg[i] += bit * p
    assert got == pytest.approx([m / total for m in marg], rel=1e-6)


def test_frame_edges(spark, model):
    long = "Nobody knows why it waits. " * 20_000
    rows = [(1, None, "issue", "", ""), (2, "", None, "", ""), (3, " \n", "log", "", ""), (4, "One. Two", None, "", ""), (None, "x", "log", "", ""), (5, long, "chat", "", ""), (6, "x", "log", "", ""), (6, "x", "log", "", "")]
    got = sentence_units(spark.createDataFrame(rows, DOC), model=model).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.sent_no, r.start_char, r.end_char))
    assert set(by) == {4, None, 5, 6} and len(by[5]) == 20_000 and by[6] == [(1, 0, 1), (1, 0, 1)]
    assert sentence_units(spark.createDataFrame([], DOC)).count() == 0


SENTENCES = ["构建失败了", "请检查日志文件", "测试在夜间运行", "我们昨天修复了缓存", "网络连接超时", "服务器返回错误代码", "部署已经完成", "磁盘空间不足", "他们正在调查原因", "依赖版本不兼容"]


def chinese(rng, n, mark):
    return mark.join(rng.choice(SENTENCES) for _ in range(n)) + mark


@pytest.fixture(scope="module")
def learnt():
    rng = random.Random(5)
    return train([chinese(rng, rng.randrange(1, 6), "。") for _ in range(400)] + [" ".join(f"The build number {rng.randrange(99)} failed again." for _ in range(rng.randrange(1, 5))) for _ in range(200)])


def test_unpunctuated_chinese_is_divided_by_posteriors(learnt):
    rng = random.Random(6)
    hit = made = true = 0
    for _ in range(60):
        parts = [rng.choice(SENTENCES) for _ in range(rng.randrange(2, 7))]
        want, at = set(), 0
        for p in parts:
            want.add((at, at + len(p)))
            at += len(p)
        got = set(units("".join(parts), None, learnt))
        hit, made, true = hit + len(got & want), made + len(got), true + len(want)
    assert hit / made >= 0.95 and hit / true >= 0.95


@pytest.mark.parametrize(
    "text, n",
    [("នេះជាប្រយោគ។ នេះជាប្រយោគទីពីរ។", 2), ("ဒါကစာကြောင်း။ဒုတိယစာကြောင်း။", 2), ("Սա նախադասություն է։ Սա երկրորդն է։", 2), ("ይህ ዓረፍተ ነገር ነው። ይህ ሁለተኛ ነው።", 2), ("यह वाक्य है। यह दूसरा है।", 2), ("这是一句。这是另一句。", 2), ("یہ جملہ ہے۔ یہ دوسرا ہے۔", 2)],
)
def test_marks_of_scripts_never_seen(learnt, text, n):
    got = list(units(text, None, learnt))
    assert len(got) == n and got[0][0] == 0 and got[-1][1] == len(text)


def test_every_gap_of_unmarked_text_may_hold_an_event(learnt):
    for text in ("ນີ້ແມ່ນປະໂຫຍກ ນີ້ແມ່ນປະໂຫຍກທີສອງ", "នេះជាប្រយោគ នេះជាប្រយោគទីពីរ", "构建失败了请检查日志"):
        w, _, _, g = tokens(text, 0, len(text))
        assert plain_gaps(w, g) == [1] * len(w)
    w, _, _, g = tokens("plain words without marks", 0, 25)
    assert plain_gaps(w, g) is None  # a space in this script separates words only


def test_a_stored_model_decides_alike(spark, learnt, tmp_path):
    save_model(spark, learnt, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    text = "构建失败了请检查日志文件磁盘空间不足\n\nThe build number 7 failed again. The build number 8 failed again."
    assert list(units(text, None, again)) == list(units(text, None, learnt))


def test_long_texts_give_spans_to_the_sample(spark):
    df = spark.createDataFrame([(1, "short text."), (2, "\n".join(f"Line {i} of a long text." for i in range(5000))), (3, None), (4, "x" * 50_000)], "doc_id long, text string")
    got = training_sample(df, kind=None, n=10, span=1000)
    assert len(got) == 3 and "short text." in got and all(len(x) <= 1000 for x in got)
    long = next(x for x in got if x.startswith("Line"))
    assert all(line.startswith("Line ") and line.endswith(" text.") for line in long.split("\n"))


def same(x, y):
    if isinstance(x, dict):
        return x.keys() == y.keys() and all(same(x[k], y[k]) for k in x)
    if isinstance(x, tuple):
        return len(x) == len(y) and all(map(same, x, y))
    return x == pytest.approx(y, rel=1e-5, abs=1e-6) if isinstance(x, float) else x == y


def test_the_model_counts_all_prose_of_the_table(spark, monkeypatch):
    """Each text whole, however long it is; logs and null texts are no prose."""
    rng = random.Random(8)
    english = ["Dr. Falmor saw it.", "Logs, dumps, etc. are kept.", "(See card 12.)", "We waited...", "It failed again!", 'He said "no. never." to us.', "ขั้นตอน เวลา lorun กข. คง มา."]
    texts = [" ".join(rng.choice(english) for _ in range(rng.randrange(1, 6))) + rng.choice(["", "\n\n- item no. 3", "\n```\ncode. x\n```\n"]) for _ in range(80)]
    texts += [chinese(rng, rng.randrange(1, 6), "。") for _ in range(60)] + ["\n\n".join(f"Line {i} waits. J. Kalop asked twice." for i in range(900)), ""]
    assert max(map(len, texts)) > 20_000
    rows = [(i, t, "issue" if i % 2 else None) for i, t in enumerate(texts)] + [(900, "ts=1 a. b", "log"), (901, None, "issue")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc_kind string")
    kept, state = [], EventModel.state
    monkeypatch.setattr(EventModel, "state", lambda m: kept.append(m) or state(m))
    models = []
    for x in (df, df.repartition(5)):
        sentence_units(x)
        models.append(state(next(m for m in reversed(kept) if m.base is None)))
    want = state(train(texts))
    assert models[0][2] == want[2] and models[0][8] and all(map(same, models[0], want))
    assert models[0] == models[1]  # whatever the partitions


def test_sightings_of_a_larger_table_are_rates():
    n3, e3 = S.Counter({("<b>", "a."): 40, ("x", "b."): 90, ("y", "b."): 5}), S.Counter({("<b>", "a."): 9, ("x", "b."): 30})
    one, ten = EventModel(set()), EventModel(set())
    one.observe(n3, e3)
    ten.observe(*(S.Counter({k: 10 * n for k, n in c.items()}) for c in (n3, e3)), 0.1)
    assert same(one.end2, ten.end2) and same(one.end3, ten.end3) and S.thinned(5) == 1.0 and S.thinned(10 * S.SIGHTED) == pytest.approx(0.1)


def test_tables_are_cut_as_single_texts_are(learnt, monkeypatch):
    """Rows of many texts, whose equal stretches are weighed once, against one text after another."""
    rng = random.Random(9)
    bits = ["a", "B.", "etc.", "3.5", "١٢", "no. ", "…", "...", "<b>", "<x.", "。", "」。", "「是。」", '"Go. ', '" ', "(see 1.) ", "(", ")", "“No!” ", "กข", "ค ", " ", "  ", "\n", "\n\n", "\r\n", " ", "\n```\n", "\n- ", "\n1. ", "# ", "构建失败了", "请检查", "ນີ້ແມ່ນ ", "។", "?! ", "¿Q?", "é.", "\x1c", "😀. "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(1500)] + ["A b. C d. " * 300, "", None, " \n ", "构建失败了请检查日志文件磁盘空间不足", "ນີ້ແມ່ນປະໂຫຍກ ນີ້ແມ່ນປະໂຫຍກທີສອງ"]
    rows = [(None if i % 50 == 7 else i // 2, t, rng.choice(["log", "issue", "chat", None])) for i, t in enumerate(texts)]
    want = [(d, no, s, e) for d, t, k in rows if t for no, (s, e) in enumerate(units(t, k, learnt), 1)]
    for size in (1, 300, S.ROW_TOKENS):
        monkeypatch.setattr(S, "ROW_TOKENS", size)
        batch = S.pa.RecordBatch.from_arrays([S.pa.array(c) for c in zip(*rows)], names=["doc_id", "text", "kind"])
        tokenised = list(S._tokenised(iter([batch])))
        assert [tuple(r.values()) for b in S._cut(learnt, iter(tokenised)) for r in b.to_pylist()] == want
    weighed = []
    monkeypatch.setattr(EventModel, "posteriors", lambda m, w, *x: weighed.append(w) or [0.9] * (x[2] - x[1] + 1))
    batch = S.pa.RecordBatch.from_arrays([S.pa.array(c) for c in ([1] * 500, ["Logs, etc. are kept. It waits. So."] * 500, ["issue"] * 500)], names=["doc_id", "text", "kind"])
    assert sum(len(b) for b in S._cut(learnt, S._tokenised(iter([batch])))) == 2000 and len(weighed) == 3


def test_texts_are_read_once_to_learn_and_to_cut(spark, tmp_path):
    rows = [(i, "Dr. Falmor saw it. It failed again! Logs, etc. are kept.\n\nWe waited... (See card 12.)", "issue") for i in range(40)] + [(99, " a. b\n\nc", "log"), (100, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, doc_kind string").write.parquet(str(tmp_path / "docs"))
    got = sentence_units(spark.read.parquet(str(tmp_path / "docs")))
    assert got.inputFiles() and not any("/docs/" in f for f in got.inputFiles())
    assert got.where("doc_id = 99").orderBy("sent_no").collect() == [(99, 1, 1, 5), (99, 2, 7, 8)] and got.select("doc_id").distinct().count() == 41
    given = sentence_units(spark.read.parquet(str(tmp_path / "docs")), model=EventModel(set()))
    assert all("/docs/" in f for f in given.inputFiles())  # nothing is stored for a model at hand
