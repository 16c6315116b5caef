import itertools
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestia.functions.fold import make_fold
from attestia.llm import abuse, boilerplate, bpe, canon, leak, nearpass, neighbours, pieces, sentences, shared

TEXTS = [
    "The quick brown fox jumps over the lazy dog near the old mill in spring.", "the lazy dog near the old mill jumps over THE quick brown fox in spring", "The quick brown fox jumps over a lazy dog near the old mill in winter!",
    "Nothing like the others at all, just some other words here.", "第二次，港务处粉刷了鱼市场，能源署随后关闭了钟楼。", "第二次，港务处粉刷了鱼市场，能源署随后关闭了钟楼！", "", None, "   ", "...", "x", "x", "Тhe quick brоwn fox jumps over the lazy dog near the old mill in spring.",
]


def brute_pairs(rows):
    words = nearpass.make_words()
    sets = {i: Counter(words(t)) for i, t in rows}
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        n = max(sum(sets[a].values()), sum(sets[b].values()))
        if n and min(sum(sets[a].values()), sum(sets[b].values())) and 5 * sum((sets[a] & sets[b]).values()) >= 4 * n:
            out.add((a, b))
    return out


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(f"t{i:03}", t) for i, t in enumerate(TEXTS)]
    for n in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))]
        for m in range(3):
            new = [w if rng.random() > 0.12 else rng.choice(vocabulary) for w in base]
            rng.shuffle(new)
            rows.append((f"r{n:02}{m}", " ".join(new[: len(new) - rng.randrange(0, 3)])))
    df = spark.createDataFrame(rows + rows[:5], "id string, t string").withColumn("class", F.lit(1)).withColumn("size", F.lit("z"))
    got = [tuple(r) for r in nearpass.near_pairs(df, "id", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)
    links = {r.id: r for r in nearpass.near_links(df, "id", "t").collect()}
    assert links["t010"]["class"] == links["t011"]["class"] and links["t003"].links == 0 and "t006" not in links


def test_near_pairs_of_nothing(spark):
    assert nearpass.near_pairs(spark.createDataFrame([], "id string, t string"), "id", "t").count() == 0


def test_hot_group_of_copies(spark):
    df = spark.range(2500).select(F.lit(1).alias("g"), F.col("id"), (F.col("id") < 2).cast("int").alias("u"))
    assert shared.pairs_within(df, ["g"], "id", "u").count() == 2 * 2498
    assert shared.pairs_within(df.filter("id < 60"), ["g"], "id").count() == 60 * 59 // 2


def slow_cuts(text):
    out, a = [], 0
    while True:
        b = min(a + 420, len(text))
        if b < len(text):
            for p in range(b - 1, a + 259, -1):
                if text[p] in "\n。！？" or (text[p : p + 2] == ". " and p + 2 <= b):
                    b = p + 1
                    break
        if text[a:b].strip():
            out.append((a, b))
        if b == len(text):
            return out
        a = b - 60


def test_pieces(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab .。\n😀甲") for _ in range(rng.randrange(400, 3000))) for _ in range(40)] + ["x" * 5000, " " * 2000, "a" * 420, "a" * 421]
    for t in texts:
        assert pieces.forward_cuts(t) == slow_cuts(t)
        cuts = pieces.bisect_cuts(t)
        assert all(b - a <= 420 for a, b in cuts)
        if t.strip() == t and "  " not in t:
            assert cuts[0][0] == 0 and cuts[-1][1] == len(t) and all(x[1] - y[0] == 60 for x, y in zip(cuts, cuts[1:]) if y[0])
    df = spark.createDataFrame([("d", ["y" * 500, None, "", " " * 500]), ("d", ["y" * 500, None, "", " " * 500]), ("e", None), (None, ["z" * 430])], "document_id string, pages array<string>").withColumn("page", F.lit(0))
    assert sorted(tuple(r) for r in pieces.forward_pieces(df).filter("document_id = 'd'").collect()) == [("d", 1, 0, 420), ("d", 1, 360, 500)]


def test_sentences(spark):
    cases = [
        ("Dr. Lee met Prof. Oz at 8 a.m. beside St. Mary. It rained 3.5 mm! Why?", ["Dr. Lee met Prof. Oz at 8 a.m. beside St. Mary.", "It rained 3.5 mm!", "Why?"]),
        ("“钥匙在哪里？”馆长问道。馆长说：“门已经关闭。” 据报道，天晴。", ["“钥匙在哪里？”馆长问道。", "馆长说：“门已经关闭。”", "据报道，天晴。"]),
        ("《它在哪里？》是一本旧书。", ["《它在哪里？》是一本旧书。"]),
        ("1. The first; the second.\n2. The third", ["1. The first; the second.", "2. The third"]),
        ("Es war am 7. Mai 1927. Er verkauft Seile, Lampen usw. Sie kam.", ["Es war am 7. Mai 1927.", "Er verkauft Seile, Lampen usw.", "Sie kam."]),
        ("Γιατί ήρθε; Ο κ. Παπάς έφυγε.", ["Γιατί ήρθε;", "Ο κ. Παπάς έφυγε."]),
        ("เปิดสะพานใหม่ ปิดตลาดปลา 897 แห่ง", ["เปิดสะพานใหม่", "ปิดตลาดปลา 897 แห่ง"]),
        ('"Is it ready?" asked Ann. See files.a.example/v2.1 for it.', ['"Is it ready?" asked Ann.', "See files.a.example/v2.1 for it."]),
    ]
    rows = [(i, t) for i, (t, _) in enumerate(cases)] + [(90, None), (91, "  "), (0, cases[0][0])]
    got = sorted(tuple(r) for r in sentences.sentences(spark.createDataFrame(rows, "k int, t string").withColumn("char_start", F.lit(7)), "k", "t").collect())
    for i, (t, want) in enumerate(cases):
        assert [t[a:b] for k, a, b in got if k == i] == want
    assert {k for k, _, _ in got} == set(range(len(cases)))


def test_unlisted_abbreviations_are_learnt(spark):
    texts = [f"The {w} sqdn. of the coast left." for w in ("old new first last green grey red blue small large north south east west lost found brave quiet loud late".split())]
    texts += ["They met sqdn. Oz at the mill.", "He left the mill. Then she came.", "They saw the mill. Nobody spoke.", "She left. " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {(r.k, texts[r.k][r.char_start : r.char_end]) for r in sentences.sentences(df, "k", "t").collect()}
    assert {t for k, t in got if k == 20} == {"They met sqdn. Oz at the mill."}
    assert {t for k, t in got if k in (21, 22)} == {"He left the mill.", "Then she came.", "They saw the mill.", "Nobody spoke."}
    model = sentences.train(df, "t")
    assert model.step[1, 1] != 1.0 and sentences.spans(texts[20], sentences.EventModel())[0] == (0, 14)
    # An event pair seen often makes a doubtful place more likely.
    chained = sentences.EventModel(None, {(0, 0): 1.5, (0, 1): 0.5, (1, 0): 0.5, (1, 1): 1.5})
    places = [(5, "stop", 1, "upper"), (9, "may", 2, "digit")]
    assert chained.posteriors(places)[1] > sentences.EventModel().posteriors(places)[1]


def test_posteriors_are_probabilities():
    model = sentences.EventModel()
    places = sentences.events("He left. She came at 3. They met Dr. Who. End", 0, 45)
    assert all(0 <= p <= 1 for p in model.posteriors(places)) and model.posteriors([]) == []


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 64))
    X = np.concatenate([centres[rng.integers(0, 30, 900)] + rng.normal(size=(900, 64)) * 0.5, np.tile(centres[:1], (8, 1))])
    rows = [(f"v{i:04}", [float(x) for x in v], "m") for i, v in enumerate(X)]
    odd = [("n1", None, "m"), ("n2", [0.0] * 64, "m"), ("n3", [float("nan")] * 64, "m"), ("n4", [1.0] * 63, "m"), ("n5", [None] + [1.0] * 63, "m"), rows[0]]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows + odd, "id string, v array<double>, m string").withColumn("n", F.lit(0)), "id", "v").collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = (U @ U.T).round(9)
    np.fill_diagonal(S, -9)
    want = {f"v{i:04}": {f"v{j:04}" for j in np.argsort(-S[i], kind="stable")[:5]} for i in range(len(X))}
    assert set(got) == set(want)
    assert sum(len(got[k] & want[k]) for k in want) / (5 * len(want)) > 0.97
    assert got["v0907"] == {"v0900", "v0901", "v0902", "v0903", "v0904"}
    few = neighbours.nearest(spark.createDataFrame(rows[:3], "id string, v array<double>, m string"), "id", "v")
    assert few.count() == 6 and neighbours.nearest(spark.createDataFrame([], "id string, v array<double>"), "id", "v").count() == 0


def test_furniture():
    judge = boilerplate.make_judge()
    page = ["Home | News | Sport", "We use cookies to improve your visit. Accept all", "Readers of Oz were told to log in or register before the vote.", "- red mosaic of Oz", "What happens next", "The harbour closed.", "", "Related articles", "Mayor sold upper railway in Dalozovo", "Back to top", "© 2020 Oz Post. All rights reserved."]
    assert judge(page, [False] * len(page)) == [1, 2, 8, 9, 10, 11]


def test_titles_are_teasers_only_in_a_slot():
    judge = boilerplate.make_judge()
    body = ["Harbour closed after the long winter storms", "The harbour closed.", "What the mayor of Oz had promised", "The mayor said nothing.", "Repairs of the lower northern railway", "Lamps for the eastern fish market", "All of it was paid."]
    assert judge(body, [False] * 7) == []
    page = [*body, "Sponsored", "Mayor sold upper railway in Dalozovo", "It ends here.", "Advertisement", "What the harbour trust was told", "They met again.", "Advertisement", "Mayor sold upper railway in Oz", "Baker lost the eastern lamp in Oz", "Well."]
    assert judge(page, [False] * len(page)) == [8, 9, 11, 14, 15, 16]
    assert judge(["A title between two template lines", "Owned", "A body."], [False] * 3) == []
    assert judge(["Site header", "A title between two template lines", "Owned", "A body."], [True, False, True, False]) == [1, 2, 3]


def test_templates_by_class(spark):
    rows = []
    for n in range(6):
        rows.append((f"s{n}", "https://a.example/x", "A Post", f"Site header\nStory number {'abcdef'[n]} told at length over a whole line of text, with an end.\nOwned by the harbour trust\nAll about ships and ropes"))
    rows += [("t0", "https://b.example/x", None, "Site header\nA story of its own, told here at length."), ("t1", None, None, None), ("t2", "", "", "  ")]
    df = spark.createDataFrame(rows, "record_key string, url string, publisher string, text string").withColumn("record_kind", F.lit("search_result"))
    got = {(r.record_key, r.line_no) for r in boilerplate.furniture_lines(df.unionByName(df)).collect()}
    assert got == {(f"s{n}", k) for n in range(6) for k in (1, 3, 4)}


def test_long_template_paragraphs_and_long_bodies(spark):
    legal = "This notice of the harbour trust is printed below every page and " + "names the ropes and lamps of the trust, " * 8 + "and ends."
    body = "A story is told here over and over, " * 12
    rows = [(f"s{n}", "https://a.example/x", "A Post", f"{body} and its name is {'abcdef'[n]}.\n{legal}\nOwned by the harbour trust") for n in range(6)]
    rows += [(f"r{n}", "https://c.example/x", "C Post", f"{body} reprinted whole.\nA short end that each copy has.") for n in range(6)]
    df = spark.createDataFrame(rows, "record_key string, url string, publisher string, text string").withColumn("record_kind", F.lit("search_result"))
    assert len(legal) > 240 and {(r.record_key, r.line_no) for r in boilerplate.furniture_lines(df).collect()} == {(f"s{n}", k) for n in range(6) for k in (2, 3)}


def test_lookalikes_equal_table(spark):
    rows = [("a", "1", "The оpened gate"), ("a", "2", "The opened gate "), ("a", "3", "the opened gate"), ("a", "4", "The opened gate"), ("b", "5", "The o​pened gate"), ("a", "6", None), ("a", "7", " "), ("a", "8", "Почему молчит"), ("a", "9", "Почeмy молчит"), ("a", "10", "Почему молчит"), ("a", "2", "The opened gate")]
    got = {tuple(r) for r in canon.lookalike_pairs(spark.createDataFrame(rows, "record_kind string, record_key string, text string").withColumn("form", F.lit(1))).collect()}
    fold, want = make_fold(), set()
    for (k, a, x), (m, b, y) in itertools.product([r for r in rows if r[2] and r[2].strip()], repeat=2):
        if k == m and a < b and x.strip() != y.strip() and fold(x.strip()) == fold(y.strip()):
            want.add((k, a, b))
    assert got == want and ("a", "8", "9") in got
    forms = {r.t: r.canonical for r in canon.canonical_texts(spark.createDataFrame([(r[2],) for r in rows], "t string"), "t").collect()}
    assert forms["Почeмy молчит"] == "Почему молчит" and forms["The оpened gate"] == "The opened gate" and forms[None] is None and forms[" "] == ""


@pytest.fixture(scope="module")
def vocabulary():
    try:
        return bpe.Vocabulary()
    except FileNotFoundError:
        pytest.skip("no tokenizer files")


def test_encoding(spark, vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    texts = [*TEXTS, "I'll  say\n\n it's 2024 ", "naïve café 😀👍🏽 ﷺ", "<|endoftext|> <s>", "a" * 3000, "据" * 300 + "医院", " \t\r\n　 ", "ทดสอบ", "aaaa aaaa" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("ids", F.lit("x"))
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df, "doc_id", "text", vocabulary).collect()}
    assert got == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    back = bpe.encode_corpus(df, "doc_id", "text", vocabulary).select("doc_id", bpe.decode(F.col("ids"), vocabulary).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {i: t or "" for i, t in enumerate(texts)}


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    zh = "据罗里梅达渡轮船长介绍，港务处测量了古地图，乐团否决了花园。"
    docs = [(1, "xx " + item.upper().replace(" ", ", ") + " yy"), (2, "two three four five six seven eight nine ten eleven twelve thirteen"), (3, "two three four five six seven eight nine ten eleven twelve"), (4, "two three four fife six seven eight nine ten eleven twelve thirteen"), (5, zh[:22]), (6, zh[:15]), (7, None), (8, ""), (2, "two three four five six seven eight nine ten eleven twelve thirteen")]
    items = spark.createDataFrame([(1, "en", item, 0), (2, "zh", zh, 0), (3, "en", None, 0), (4, "en", "short", 0), (1, "en", item, 0)], "item_id bigint, lang string, text string, edits int")
    got = leak.leaked(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0)), "doc_id", "text", items).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.edits == 0} == {(1, 1), (2, 1), (5, 2)}
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (4, 1), (5, 2)}


def test_exact_copy_after_an_edited_one(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    once, twice = item.replace("five", "fife"), item.replace("five", "fyfe").replace("nine", "nyne")
    texts = [f"{once} and then {item}", f"{twice} or {once}", f"{item} and then {once}", once]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [(r.doc_id, r.edits) for r in leak.leaked(docs, "doc_id", "text", spark.createDataFrame([(1, "en", item)], "item_id bigint, lang string, text string")).collect()]
    assert sorted(got) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_abuse_search_is_exact_and_forms_are_undone(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    # Examples of one topic share words, so most blocks cannot reach the best ones.
    examples = [(i, [f"w{(i % 20) * 20 + rng.randrange(20)}" for _ in range(8)] + [rng.choice(words)], i % 2) for i in range(600)]
    ix = abuse.Index(examples, {}, 1000)
    queries = [[f"w{t * 20 + rng.randrange(20)}" for _ in range(6)] + ["unknown"] for t in range(20)] + [[], ["unknown"]]
    sims, near = ix.nearest(queries, 5)

    def dense(texts):
        rows, features, weights = ix.vectors(texts)
        m = np.zeros((len(texts), len(ix.idf)))
        m[rows, features] = weights
        return m

    slow = dense(queries) @ dense(ix.texts).T
    assert np.allclose(sims, -np.sort(-slow, axis=1)[:, :5]) and (near[-2:] == -1).all()
    assert np.allclose(np.take_along_axis(slow, np.maximum(near, 0), 1), sims)
    assert ix.read < ix.met / 2  # blocks are really skipped
    left_out = ix.nearest(ix.texts[:50], 1, list(range(50)))[1]
    assert all(a != b for a, (b,) in enumerate(left_out))
    samples = [(1, "You are a filthy idiot and everyone knows it.", 1), (2, "The harbour opened in spring near the mill.", 0), (3, "Police found the old map.", 0), (4, "Nobody asked you, idiot; crawl back into your hole.", 1)]
    docs = [(1, "You are a f1lthy i-d-i-o-t and everyone knows it. Fine."), (2, "The harbour opened in spring."), (3, None), (4, ""), (5, "YОU ARE A FILTHY IDIIIIOT AND EVERYONE KNOWS IT"), (2, "The harbour opened in spring.")]
    s = spark.createDataFrame(samples, "sample_id bigint, text string, is_abusive int")
    got = [(r.doc_id, r.score >= abuse.THRESHOLD, r.evidence) for r in abuse.scores(spark.createDataFrame(docs, "doc_id int, text string").withColumn("score", F.lit(1)), "doc_id", "text", s).collect()]
    assert sorted(x for x, hit, _ in got if hit) == [1, 5] and len(got) == 6


def test_abusive_words_of_any_shape_count(spark):
    features = [f for p in abuse.make_passages()("Salope, tarado, degenerate parasite, 12.") for f in p]
    assert {"salope", "tarado", "degenerate", "parasite"} <= set(features) and "12" not in features
    samples = [(1, "The mayor is a parasite.", 1), (2, "The mayor is a potato.", 0), (3, "You are a salope.", 1), (4, "You are a camera.", 0), (5, "The harbour opened in spring.", 0)]
    docs = [(1, "The mayor is a parasite"), (2, "The mayor is a potato"), (3, "You are a sаlope"), (4, "You are a camera")]
    got = abuse.scores(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text", spark.createDataFrame(samples, "sample_id bigint, text string, is_abusive int")).collect()
    s = {r.doc_id: r.score for r in got}
    assert min(s[1], s[3]) >= abuse.THRESHOLD > max(s[2], s[4])


def test_bands_and_bounds():
    bands = nearpass._bands(5000)
    assert all(a < b for a, b in zip(bands, bands[1:])) and bands[0] == 1
    for s in range(1, 400):
        for t in range(-(-4 * s // 5), s + 1):
            # The most differences at the least overlap.
            assert nearpass._allowed(s, t, Fraction(4, 5)) == s + t - 2 * -(-4 * s // 5) >= 0


def test_edit_automaton_weights():
    from attestia.functions.fold import make_fold

    fold = make_fold()
    for budget, want in ((0, {"мир"}), (1, {"мир", "мор", "мира"})):
        trie = canon.Trie(fold, budget)
        for token, n in (("мир", 5), ("мор", 2), ("мира", 1), ("другой", 9)):
            trie.add(token, n)
        # Latin p for Cyrillic р, a zero-width joiner inside.
        got = trie.spellings("ми‍p")
        assert {t for *_, t in got} == want and got[0][::3] == (0, "мир")
    trie = canon.Trie(fold)
    trie.add("ﬁn", 1)
    trie.add("f­in", 1)
    assert {t for *_, t in trie.spellings("fin")} == {"ﬁn", "f­in"}
    # A disguised word takes the spelling most texts use, an honest one stays.
    trie = canon.Trie(fold)
    for token, n in (("кот", 7), ("кoт", 1)):
        trie.add(token, n)
    assert trie.canonical("кoт") == trie.canonical("кот") == "кот" == canon.by_table("кот", fold) != canon.by_table("кoт", fold)


def test_sentences_without_marks(spark):
    # What begins and ends sentences is learnt from the punctuated texts of the same language.
    subjects, verbs, ends = ("the mayor", "the old baker", "nobody", "she", "every farmer"), ("sold", "painted", "closed", "found"), ("the mill", "a bridge", "the harbour", "an organ")
    rng = random.Random(4)
    one = lambda: f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(ends)} {rng.choice(('yesterday', 'last spring', 'again'))}"
    texts = [". ".join((x := one())[0].upper() + x[1:] for _ in range(4)) + "." for _ in range(300)]
    kana = [("ねこがさかなをたべました", "いぬはそとでねむります", "とりがそらをとびました")[n % 3] + "。" for n in range(300)]
    plain = [one() for _ in range(5)]
    texts += ["".join(kana[:3])] * 100 + [" ".join(plain), "ねこがさかなをたべました" + "いぬはそとでねむります", "a heading of many words in a row that is no more than the title of one long report on the mill"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got: dict = {}
    for r in sentences.sentences(df, "k", "t").collect():
        got.setdefault(r.k, []).append((r.char_start, texts[r.k][r.char_start : r.char_end]))
    n = len(texts)
    assert [t for _, t in sorted(got[n - 3])] == plain
    assert [t for _, t in sorted(got[n - 2])] == ["ねこがさかなをたべました", "いぬはそとでねむります"]
    # Brand names, dialogue and units of one letter.
    model = sentences.EventModel()
    cut = lambda t: [t[a:b] for a, b in sentences.spans(t, model)]
    assert cut("It melts at 71 K. The end. eVasa sold it. —¿Dónde? —dijo Ann. Γιατί; Ο κ. Παπάς.") == ["It melts at 71 K.", "The end.", "eVasa sold it.", "—¿Dónde? —dijo Ann.", "Γιατί;", "Ο κ. Παπάς."]
