"""The problems of text data against brute force, round trips and held-out cases."""

import random

import numpy as np
import pytest

from lumenframe.llm import charset_repair as C
from lumenframe.llm import names as N
from lumenframe.llm import packing as P
from lumenframe.llm import tokens as K
from lumenframe.llm import toxicity as X

# -- encoding ---------------------------------------------------------------------------------------------------

AWKWARD = ["", None, " ", "  two  spaces ", "tab\tand\nlines\n\n  x", "it's we'll THEY'RE 'tis", "naïve café – 東京の天気。 emoji 👩‍👩‍👧 done", "　wide nbsp\x85nel\x1fus", "a" * 900, "<|endoftext|> 123 4,5", "ends with space ", "\n\n\nP", "x" * 300 + " " + "y " * 200]


def test_ids_equal_those_of_the_whole_text(spark):
    rng = random.Random(7)
    texts = AWKWARD + ["word's é, " * 3000, "多" * 9000, " " * 9000 + "x", "ab " * 4096 + "\n" * 5000] + ["".join(rng.choice(["ab", " ", "\n", "'ll", "7", "é", "  ", "。", "-", "Z"]) for _ in range(rng.randrange(2500))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y"), (5, texts[5], "y")], "doc_id bigint, text string, ids string")
    e = K.encoding()
    for chunk, overlap in ((K.CHUNK, K.OVERLAP), (200, 40), (50, 10)):
        rows = K.encode_documents(df, chunk=chunk, overlap=overlap).collect()
        assert len(rows) == len(texts) + 2
        for r in rows:
            assert list(r.ids) == (e.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else []), (chunk, texts[r.doc_id][:40])
            assert b"".join(e.decode_single_token_bytes(i) for i in r.ids).decode() == (texts[r.doc_id] or "")
        decoded = K.decode_documents(K.encode_documents(df, chunk=chunk, overlap=overlap)).collect()
        assert len(decoded) == len(rows) and all(r.text == (texts[r.doc_id] or "") for r in decoded)
        counts = {r.doc_id: r.n_tokens for r in K.encode_documents(df, count=True, chunk=chunk, overlap=overlap).collect()}
        assert counts == {r.doc_id: len(r.ids) for r in rows}
    assert K.encode_documents(df.limit(0)).count() == 0 and K.decode_documents(K.encode_documents(df.limit(0))).count() == 0
    null = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in K.decode_documents(null).collect()} == {1: None, 2: ""}


# -- packing ----------------------------------------------------------------------------------------------------


def _brute_rule(sizes, capacity):
    gaps, where, bins = {}, [], []
    for s in sizes:
        best = None
        for g in [g for g, n in gaps.items() if n and g >= s] + ["new"]:
            after = dict(gaps)
            left = (capacity if g == "new" else g) - s
            if g != "new":
                after[g] -= 1
            if left:
                after[left] = after.get(left, 0) + 1
            cost = (sum(n * n for n in after.values()) - sum(n * n for n in gaps.values()), capacity if g == "new" else g)
            if best is None or cost < best[0]:
                best = (cost, g, after)
        _, g, gaps = best
        i = len(bins) if g == "new" else max(j for j, b in enumerate(bins) if capacity - sum(b) == g)
        if g == "new":
            bins.append([])
        bins[i].append(s)
        where.append(sum(bins[i]))
    return sorted(map(sorted, bins))


def test_rule_equals_brute_force():
    rng = random.Random(8)
    for _ in range(30):
        sizes = [rng.randrange(1, 21) for _ in range(40)]
        found = P.sum_of_squares(np.array(sizes), 20)
        bins = {}
        for s, b in zip(sizes, found, strict=True):
            bins.setdefault(int(b), []).append(s)
        assert max(map(sum, bins.values())) <= 20
        assert sorted(map(sum, bins.values())) == sorted(map(sum, _brute_rule(sizes, 20)))


def test_packing_is_whole_and_close_to_the_bound(spark):
    rng = random.Random(9)
    sizes = [(i, rng.choice([0, None, 7, rng.randrange(1, 90), rng.randrange(1, 400)])) for i in range(900)] + [(3, 5), (None, 4)]
    items = spark.createDataFrame(sizes, "doc_id bigint, n_tokens int")
    containers = spark.createDataFrame([("s", 64), ("l", 256), ("l", 256), ("none", 0)], "container string, capacity_tokens int")
    rows = P.pack(items, containers, group_items=300).collect()
    want = {}
    for i, n in sizes:
        if i is not None:
            want[i] = max(want.get(i, 0), n or 0)
    for name, capacity in (("s", 64), ("l", 256)):
        own = [r for r in rows if r.container == name]
        load, held = {}, {}
        for r in own:
            load[r.bin_id] = load.get(r.bin_id, 0) + r.size
            held.setdefault(r.doc_id, []).append((r.token_start, r.size))
        assert max(load.values()) <= capacity and set(held) == set(want)
        for i, parts in held.items():
            assert sum(s for _, s in parts) == want[i] and (len(parts) == 1 or want[i] > capacity)
            at = 0
            for start, size in sorted(parts):
                assert start == at
                at += size
        assert len(load) <= 1.06 * -(-sum(want.values()) // capacity) + 2
    assert P.pack(items.limit(0), containers).count() == 0


# -- names ------------------------------------------------------------------------------------------------------


def _link(spark, rows):
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "name_id bigint, last_name string, first_name string, middle_name string, birth_date string, sex string, person string")
    return {tuple(r) for r in N.pairs(N.link(df)).collect()}


def test_variants_meet_and_namesakes_do_not(spark):
    b = "19620304"
    rows = [
        ("Quavortaby", "Richard", "Hugo", b, "M"), ("QUAVORTABY ", "dick", None, b, "M"), ("Richard", "Quavortaby", None, "1962.03.04", None), ("Quavortaby, R.", None, None, b, "M"), ("Qauvortaby", "Richrad", "H", b, "M"),
        ("Richard Hugo van Quavortaby", "", "", "19620403", "M"), ("Quavortaby", "Richard (Rick)", "Hugo", None, "M"),
        ("Quavortaby", "Anna", None, b, "F"),  # twin
        ("Straselkamür", "Zoe", None, "19300101", "F"), ("Straselkamuer", "Zoe", None, "19500101", "F"), ("Straselkamur", "Zoe", None, None, "F"),  # namesakes and one that may be either
        (None, None, None, b, "M"), ("  ", "", None, None, None),
    ]
    got = _link(spark, rows)
    assert got == {(a, c) for a in range(7) for c in range(a + 1, 7)}


def test_exact_copies_without_dates_meet(spark):
    assert _link(spark, [("Yorlenbach", "Tibor", None, None, "M"), ("yorlenbach", "TIBOR", None, None, "M"), ("Yorlenbach", "Tibor", None, None, "F")]) == {(0, 1)}
    assert _link(spark, [("A", "B", None, None, None)][:0] or [(None, None, None, None, None)]) == set()


def test_rarest_shared_form_tells_persons_apart_that_fit_alike(spark):
    rows = [("Carter", "Anna", None, None, "F"), ("Cartera", "Anna", None, "19300101", "F"), ("Carers", "Anna", None, "19500101", "F"), ("Carers", "Anna", None, "19600101", "F")]
    assert _link(spark, rows) == {(0, 1)}  # CARTER is shared by two spellings, CARER by three


def test_linking_rewrites_names_once_and_broadcasts_nothing(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    names = [("Carter", "Anna", None, "19300101", "F"), ("Carter", "Anna", None, None, "F"), ("Yorlenbach", "Tibor", None, None, "M"), ("yorlenbach", "TIBOR", None, None, "M")]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert _link(spark, names) == {(0, 1), (2, 3)}
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == threshold
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = [x for x in (store.executionsList().apply(i) for i in range(store.executionsList().size())) if x.executionId() not in before]
    writes = [x.physicalPlanDescription() for x in ran if "InsertIntoHadoopFsRelationCommand" in x.physicalPlanDescription()]  # the tables that linking writes
    assert writes
    assert sum("MapInArrow" in p for p in writes) == 1
    assert not any("BroadcastExchange" in p for p in writes)


# -- wrong decoding ---------------------------------------------------------------------------------------------

SOUND = ["Die Prüfung für Müller ist später in der Bäckerei.", "Le café a été fermé après l'été à Montréal.", "Mañana habrá más información según la compañía.", "Больница города и садовая стоянка после операции.", "図書室は少し古いです。申込書を返送してください。", "Wątroba powiększona, złamanie łokcia, Łódź.", "plain words only", "SÃO VALDOR revisión", "It’s no secret – “we never thought”"]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(10)
    texts = [(i, " ".join(rng.choice(s.split()) for _ in range(6)) if rng.random() < 0.5 else s) for i in range(400) for s in SOUND]
    return C.Model.of(C.pair_counts(spark.createDataFrame(texts, "i int, text string")))


def test_run_beside_characters_the_decoder_lacks_is_restored(model):
    garbled = "申込書".encode().decode("cp1252")
    word = f"{garbled}を返送してください。図書室"
    assert len(model.runs(word)) > 1
    assert model.restore(word) == ("申込書を返送してください。図書室", "cp1252 for utf-8")
    assert model.restore("申込書を返送してください。図書室") is None


@pytest.mark.parametrize("right, wrong", [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("cp1252", "iso8859-5"), ("cp1252", "cp437"), ("iso8859-2", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "latin-1"), ("shift_jis", "latin-1"), ("euc_jp", "latin-1")])
def test_damage_is_found_and_undone(model, right, wrong):
    tried = undone = 0
    for s in SOUND:
        try:
            broken = s.encode(right).decode(wrong)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if broken == s or s.isascii() or "SÃO" in s:
            continue
        found = model.judge(broken)
        assert found is not None, (s, broken)
        tried += 1
        undone += found[0] == s
    assert tried and undone >= 0.5 * tried


def test_sound_and_quoted_texts_are_left(model):
    for s in [*SOUND, "", None, "Tip: a page shows “Ã¼” instead of “ü” here.", "The glyph � stands for a byte that was lost.", "names turn into РџСЂРё on old phones"]:
        assert model.judge(s) is None, s


def test_lost_characters_and_escapes(model):
    assert model.judge("k�mmern um L�rm")[1] == "lost"
    assert model.judge("\x1b$B?eF#\x1b(B")[0] == "水藤"


def test_segments_are_the_maximal_ones():
    assert C.segments([-1, 2, -1, 3, -9, 4, 0, -1]) == [(1, 4), (5, 6)]
    assert C.segments([]) == [] and C.segments([-1.0, -2.0]) == []


def test_repair_over_a_table(spark):
    rows = [("documents", i, s) for i, s in enumerate(SOUND * 30)] + [("elements", 1, "Die PrÃ¼fung fÃ¼r MÃ¼ller"), ("elements", 1, "Die PrÃ¼fung fÃ¼r MÃ¼ller"), ("elements", 2, None), ("elements", None, "fÃ¼r")]
    got = C.repair(spark.createDataFrame(rows, "origin string, record_id bigint, text string")).collect()
    assert [(r.origin, r.record_id, r.restored) for r in got] == [("elements", 1, "Die Prüfung für Müller")]
    assert C.repair(spark.createDataFrame([], "origin string, record_id bigint, text string")).count() == 0


# -- abusive language -------------------------------------------------------------------------------------------


def test_index_finds_what_brute_force_finds():
    rng = np.random.default_rng(11)
    rows, features = 300, 40
    dense = rng.random((rows, features)) * (rng.random((rows, features)) < 0.15)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    r, f = np.nonzero(dense)
    index = X.Index.build(r, f, dense[r, f])
    for step in (50, 4_000_000):
        q, e, c = index.find(r, f, dense[r, f], 0.3, step)
        exact = dense @ dense.T
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(exact >= 0.3), strict=True)}
        got = {(int(a), int(b)) for a, b in zip(q, e, strict=True)}
        assert not {p for p in got ^ want if abs(exact[p] - 0.3) > 1e-9}
        assert np.allclose(c, exact[q, e])


@pytest.mark.parametrize("token, word", [("рorno", "porno"), ("d.i.s.g.u.s.t", "disgust"), ("Id1ot!!!", "idiot"), ("ab_ruti", "abruti"), ("r-é-p-u", "repu"), ("user12:", ""), ("2024", "0"), ("loooser", "loser"), ("—", "")])
def test_disguises_fold(token, word):
    assert X.fold(token) == word


def test_scores_of_held_out_documents(spark):
    rng = random.Random(12)
    nouns, insults = ["kettle", "ferry", "garden", "archive", "printer"], ["idiot", "moron", "loser", "scumbag", "clown"]
    calm = lambda: f"The {rng.choice(nouns)} in {rng.choice(['Talmora', 'Quillon', 'Minatsu'])} is {rng.choice(['quiet', 'noisy', 'late', 'cheap'])}."
    rude = lambda: rng.choice([f"You are such a stupid {rng.choice(insults)}!", f"Shut up you filthy {rng.choice(insults)}", f"Get lost you {rng.choice(insults)}, you piece of trash."])
    docs, truth = [], {}
    for i in range(900):
        parts = [calm() for _ in range(5)]
        truth[i] = i % 8 == 0
        if truth[i]:
            parts.insert(rng.randrange(5), rude())
        docs.append((i, "\n".join(parts), f"s{i % 3}", "clash"))
    docs += [(2000, None, "s0", "x"), (2001, "", None, "x"), (2002, "!!! …", "s1", "x"), (0, docs[0][1], "s0", "x")]
    votes = [(i, int(truth[i]) if rng.random() > 0.04 else int(not truth[i])) for i in range(450)] + [(None, 1), (5, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, toxic string")
    model = X.fit(d, spark.createDataFrame(votes, "doc_id bigint, toxic int"))
    rows = X.score_documents(d, model)
    got = {r.doc_id: r.toxic_score for r in rows.collect()}
    assert all(got[i] == 0 for i in (2000, 2001, 2002)) and len(got) == 903
    flagged = {i for i in range(450, 900) if got[i] >= X.THRESHOLD}
    want = {i for i in range(450, 900) if truth[i]}
    assert len(flagged & want) >= 0.95 * len(want) and len(flagged - want) <= 0.03 * len(flagged)
    rates = {r.source: (r.documents, r.toxic) for r in X.source_rates(d, rows).collect()}
    assert sum(n for n, _ in rates.values()) == 903 and rates[None] == (1, 0)


def test_without_votes_everything_scores_nothing(spark):
    d = spark.createDataFrame([(1, "You are an idiot")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.toxic_score for r in X.score_documents(d, X.fit(d, none)).collect()] == [0.0]
    assert X.score_documents(d.limit(0), X.fit(d.limit(0), none)).count() == 0


def test_toxic_wording_of_one_labelled_document_is_kept(spark):
    rng = random.Random(5)
    places, things = ["Talmora", "Quillon", "Marbeck", "Oldwick"], ["parking", "heating", "noise", "storage"]
    plain = lambda: f"In {rng.choice(places)} the {rng.choice(things)} office asked for more news about {rng.choice(things)}."
    docs = [(i, "\n".join(plain() for _ in range(3))) for i in range(200)]
    threat, slur = "I swear we shall find and throttle your kin", "grubby zorblat vermin"
    docs += [(300, f"{plain()}\n{threat}"), (301, slur), (302, plain()), (303, f"{plain()}\n{threat}!"), (304, f"{slur}!\n{plain()}"), (305, plain())]
    votes = [(i, 0) for i in range(150)] + [(300, 1), (301, 1), (302, 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.toxic_score for r in X.score_documents(d, X.fit(d, spark.createDataFrame(votes, "doc_id bigint, toxic int"))).collect()}
    assert {i for i, score in got.items() if score >= X.THRESHOLD} == {300, 301, 303, 304}
