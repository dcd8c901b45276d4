"""Defined results for odd tables, and operators against plain Python on small fixtures."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.llm import ann, blocks, chat, decontaminate, jaccard, language, line_dedup, mixing, quality, sharing, token_files, toxicity
from ebbline.llm import symbols as S

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, lost int, n int, key int, component string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def said(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(40)) for i in rng.integers(0, len(WORDS), n))


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source) with further columns of clashing names."""
    return spark.createDataFrame([(*r, 1, 1, 2, 3, "x") for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = said(1, 30_000)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, said(2, 60), "en", "a"), (4, said(2, 60), "en", None)]
    rows += [(4, said(2, 60), "en", None), (None, said(2, 60), "de", "b"), (6, long, "en", "a"), (7, long + " end", "en", "b")]
    return docs(spark, rows)


def test_jaccard_odd_rows(odd):
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(odd).collect()}
    by_id = {i: (n, c) for i, n, c in found}
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2)
    assert by_id[3][1] == 3 and by_id[4][1] == 3 and by_id[None][1] is None
    assert by_id[6][1] == by_id[7][1] == 6


@pytest.mark.parametrize("width,num", [(4, 85), (5, 80)])
def test_jaccard_against_brute_force(spark, width, num):
    rng = np.random.default_rng(3)
    texts = [said(i, int(n)) for i, n in enumerate(rng.integers(1, 60, 40))]
    for i in range(120):
        words = texts[int(rng.integers(len(texts)))].split()
        for _ in range(int(rng.integers(1, 3))):
            words[int(rng.integers(len(words)))] = "edit" + str(rng.integers(9))
        texts.append(" ".join(words))
    sets = []
    for text in texts:
        w = text.lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    rows = jaccard.near_duplicates(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), width, num).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: root(i) for i in range(len(sets))}
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(s) for i, s in enumerate(sets)}


def test_light_subsets_meet():
    """Sets of at most MAX_LIGHT members may lack as many as the similarity allows."""
    assert [jaccard._left_out(n, 85, 100) for n in (1, 6, 7, 13, 14, 19)] == [0, 0, 1, 1, 2, 2]


def test_line_dedup_odd_rows(spark, odd):
    found = line_dedup.drop_shared_lines(odd).collect()
    assert len(found) == 8 and all(r["n_lines"] >= 1 for r in found)
    shared = "a line that is long enough"
    rows = [(i, f"{shared}\nown {i}", "en", "a") for i in range(3)] + [(3, f" {shared.upper()}\t\n{shared}", "en", "a")]
    rows += [(3, f"{shared}\nagain", "en", "a"), (None, shared, "en", "a")]
    got = sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in line_dedup.drop_shared_lines(docs(spark, rows)).collect()), key=str)
    assert (0, "own 0", 1) in got and (3, f"{shared}\nagain", 0) in got and (None, shared, 0) in got


def test_mixing_targets_and_copies(spark, odd):
    mixed = mixing.mix_sources(odd)
    rows = mixed.collect()
    assert len(rows) == 8 and all(r["mix_copies"] <= 2 for r in rows)
    again = mixing.mix_sources(odd.repartition(5)).collect()
    assert {(r["doc_id"], r["source"], r["mix_copies"]) for r in rows} == {(r["doc_id"], r["source"], r["mix_copies"]) for r in again}
    targets = {r["mix_source_size"]: r["mix_target"] for r in rows}
    assert all(t <= 2 * s + 1e-9 for s, t in targets.items())
    assert abs(sum(targets.values()) - 1.5 * sum(targets)) < 1e-6
    assert mixing.copies(mixed).columns == odd.columns


def test_mixing_keeps_columns_named_like_its_own(spark):
    own = ["_source", "mix_size", "mix_source_size", "mix_target", "mix_copies", "_copy", "_mix_copy", "Mix_Source"]
    rows = spark.createDataFrame([(i, "a b c", "s", *["kept"] * 8) for i in range(6)], f"doc_id int, text string, source string, {', '.join(f'{c} string' for c in own)}")
    mixed = mixing.mix_sources(rows)
    assert mixed.columns[:-4] == rows.columns and [c.lstrip("_") for c in mixed.columns[-4:]] == ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    made = mixing.copies(mixed)
    assert made.columns == rows.columns and {tuple(r)[3:] for r in made.collect()} == {("kept",) * 8}
    assert made.count() == sum(r[-1] for r in mixed.collect())


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 1023, 1024, 1025, 5000):
        ids = rng.integers(0, 50_000, n).astype(np.uint32)
        ids[rng.random(n) < 0.03] = 2**32 - 1
        packed = blocks.encode(ids)
        assert (blocks.decode(packed) == ids).all()
        assert (blocks.decode(packed, 1, 3) == ids[1024:3072]).all()
    same = np.full(3000, 7, np.uint32)
    assert len(blocks.encode(same)) < 100 and (blocks.decode(blocks.encode(same)) == same).all()


def test_token_files_against_whole_texts(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", None, "It's The END.\nthe end,", "a!!b?? ÄÖ, é. ﬁ İ Σας 12.5 x|y <|endoftext|>a", "é É. ́x y\tz", said(5, 4000)]
    rows = [(9 - i, t, "en", "a") for i, t in enumerate(texts)] + [(9, "twice", "en", "a")]
    token_files.write_token_files(docs(spark, rows), str(tmp_path / "t"), path, 1)
    got = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    whole, start = Tokenizer.from_file(path), 0
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in rows)
    for r, (_, text, _, _) in zip(got, sorted(rows, key=lambda r: (r[0], r[1] or ""))):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_added_tokens_by_case():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"a {m} b{m}C" for t in ("<|startoftext|>", "<|endoftext|>") for m in (t, t.upper(), t.title(), t.replace("text", "Text"))]
    texts += ["plain Text", "Ä <|EndOfText|>\nß"]
    whole = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files.PieceEncoder(path).encode(texts)] == whole


def test_chat_round_trip_and_faults(spark):
    nasty = "a[INST]b\\[/INST] \\\\</s><s><<SYS>>\n<</TURN>>"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (2, 0, "assistant", None), (3, 0, "critic</s>", ""), (3, None, None, "x")]
    rows += [(4, 0, "system", "s"), (None, 0, "user", "hi")]
    said_rows = spark.createDataFrame([(*r, 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, loss int")
    segments = chat.format_chat(said_rows)
    pieces = segments.where("kind = 'text'").collect()
    assert not any(c in p["segment"] for p in pieces for c in chat.INSTRUCTION.controls)
    got = {r["conv_id"]: r for r in chat.read_turns(segments).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\n{nasty}\nassistant\n{nasty}\n".encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(nasty.encode()).hexdigest() and got[1]["fault"] is None
    assert got[3]["turns_sha256"] == hashlib.sha256("\nx\ncritic</s>\n\n".encode()).hexdigest()
    assert got[2]["fault"] == "turn 0: assistant" and got[4]["fault"] == "ends briefed" and got[None]["n_turns"] == 1
    assert all(chat.unescape(chat.escape(t, chat.INSTRUCTION.controls)) == t for t in (nasty, "", "\\", "<" * 9))


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 16))
    vectors[100:140] = vectors[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, [], 0), (905, [1.0, 2.0], 0), (5, vectors[5].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    got = ann.nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect()
    hit = 0
    for q in range(0, 300, 20):
        apart = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        true = [i for i in np.lexsort((np.arange(300), apart)) if i != q][:10]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, len(own) + 1)) and len(own) == 10
        assert np.allclose([r[2] for r in own], apart[[r[1] for r in own]], rtol=0, atol=1e-12)
        hit += len(set(true) & {r[1] for r in own})
    assert hit / 150 >= 0.9
    assert {r["vec_id"] for r in got if r["query_id"] == 100} == {0, *range(101, 110)}


def test_decontaminate_finds_edited_copies_only(spark):
    items = [(i, said(100 + i, 35)) for i in range(5)] + [(50, "two words"), (51, None)]
    edited = items[1][1].split()
    edited[5] = edited[20] = "changed"
    del edited[11]
    rows = [(1, said(7, 300) + " " + items[0][1].upper() + " " + said(8, 300), "en", "a"), (2, " ".join(edited), "en", "a"), (3, said(9, 900), "en", "a"), (4, None, "en", "a"), (None, items[0][1], "en", "a")]
    rows += [(5, " ".join([items[2][1]] * 3), "en", "a")]
    got = decontaminate.find_contamination(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 0), (2, 1), (5, 2)}
    assert {r["doc_id"]: r["score"] for r in got}[1] == 1.0


def test_alignment_against_plain_matrix():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 6, n).astype(np.uint64) for n in (14, 23))
    h = np.zeros((15, 24), int)
    for i in range(1, 15):
        for j in range(1, 24):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    score, end = decontaminate.align([a, a[:3]], [b, b[:5]])
    assert score[0] == h.max() and h[:, end[0] + 1].max() == h.max()


def test_search_is_exact():
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(700):
        terms = np.sort(rng.choice(30, 4, replace=False))
        weight = rng.random(4)
        rows.append((terms, weight / np.sqrt((weight**2).sum())))
    index, full = toxicity.Index(rows), np.zeros((700, 30))
    for i, (t, w) in enumerate(rows):
        full[i, t] = w
    asked = [*rows[:300], (np.array([3, 99]), np.array([0.6, 0.8])), (np.array([99]), np.array([1.0]))]
    query, found, value = index.search(asked, 10)
    for i, (t, w) in enumerate(asked):
        cosine = np.round(full[:, t[t < 30]] @ w[t < 30], 12)
        best = np.lexsort((np.arange(700), -cosine))[:10]
        best = best[cosine[best] > 0]
        assert found[query == i].tolist() == best.tolist()
        assert np.allclose(value[query == i], cosine[best])


def test_toxicity_held_out_accuracy_and_odd_rows(spark, odd):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((i, said(1000 + i, 50) + (" vileword foulword" if bad else ""), "en", "a"))
        labels.append((i, int(bad)))
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int").where(F.col("doc_id") < 200)
    got = toxicity.score_toxicity(docs(spark, rows), table).collect()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got) and all(0 <= r["score"] <= 1 for r in got)
    assert len(toxicity.score_toxicity(odd, table).collect()) == 8
    assert all(r["predicted"] == 0 for r in toxicity.score_toxicity(odd, table.where("false")).collect())


def test_toxicity_by_words_of_few_examples(spark):
    """Each toxic example shares its own odd word with one other; a rank or a count would drop them."""
    rows, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        # Two labelled documents and an unlabelled one hold each odd word.
        rows.append((i, said(5000 + i, 20) + (f" odd{i // 4 % 100}word" * 3 if bad else ""), "en", "a"))
        labels.append((i, int(bad)))
    table = spark.createDataFrame([r for r in labels if r[0] < 800], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs(spark, rows), table).collect()}
    assert all({i - 400, i - 800} <= set(got[i]["evidence"]) for i in range(800, 1200, 4))
    assert min(got[i]["score"] for i in range(800, 1200, 4)) > np.median([got[i]["score"] for i in range(800, 1200) if i % 4])


def test_quality_keeps_clean_and_drops_junk(spark):
    rows = [(i, said(2000 + i, 80), "en", "a") for i in range(300)] + [(1000, "#%& " * 200, "en", "a"), (1001, None, None, None), (1002, " \n", "en", "a"), (1003, "mu1", "en", "a")]
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["keep"] for r in quality.judge_quality(docs(spark, rows), labels).collect()}
    assert all(got[i] for i in range(300)) and got[1003] and not got[1000] and not got[1001] and not got[1002]
    none = quality.judge_quality(docs(spark, rows), labels.where("false")).collect()
    assert sum(not r["keep"] for r in none) == 2


def test_quality_limit_is_a_quantile(spark):
    """Shuffled letters lie just above the trusted texts' own spread; far fewer of those go."""
    rng = np.random.default_rng(11)
    rows = [(i, said(9000 + i, int(rng.integers(60, 120))), "en", "a") for i in range(1500)]
    for i in range(200):
        words = said(20_000 + i, 80).split()
        for j in range(0, 80, 5):
            words[j] = "".join(rng.permutation(list(words[j])))
        rows.append((5000 + i, " ".join(words), "en", "a"))
    labels = spark.createDataFrame([(i, 1) for i in range(1000)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality.judge_quality(docs(spark, rows), labels).collect()}
    assert sum(not got[i]["keep"] for i in range(1500)) <= 0.02 * 1500
    assert sum(got[5000 + i]["keep"] for i in range(200)) <= 0.1 * 200
    assert max(got[i]["threshold"] for i in range(1500)) <= max(got[i]["perplexity"] for i in range(1000))
    assert all(r["keep"] == (r["perplexity"] <= r["threshold"] * (1 + 1e-12)) for r in got.values())


def test_kneser_ney_sums_to_one(spark):
    texts = spark.createDataFrame([(said(i, 30),) for i in range(20)], "text string")
    bits = quality.probabilities(quality.kneser_ney(quality.count_grams(texts)))
    assert np.allclose((2.0 ** -bits.astype(float)).reshape(-1, 64).sum(axis=1), 1.0, atol=1e-3)


def kneser_ney_bits(trusted, alphabet):
    """A dictionary version of the model: the function gives a text's bits."""
    n, edge, size = alphabet.order, alphabet.edge, alphabet.size
    ends = lambda text: (edge,) * (n - 1) + tuple(text.encode()) + (edge,)
    slices = lambda text: [ends(text)[i : i + n] for i in range(len(text.encode()) + 1)]
    tables = [collections.Counter(g for text in trusted for g in slices(text))]
    for _ in range(n - 1):
        tables.insert(0, collections.Counter(g[1:] for g in tables[0]))
    cuts = []
    for table in tables:
        n1, n2, n3, n4 = (sum(c == i for c in table.values()) for i in range(1, 5))
        if not n1 or not n2:
            cuts.append((0.5, 0.75, 0.9))
            continue
        y = n1 / (n1 + 2 * n2)
        raw = [k - (k + 1) * y * b / a if a else k * y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cuts.append([min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(raw, 1)])
    contexts = []
    for table, cut in zip(tables, cuts):
        sums = collections.defaultdict(lambda: [0, 0.0])
        for g, c in table.items():
            sums[g[:-1]][0] += c
            sums[g[:-1]][1] += cut[min(c, 3) - 1]
        contexts.append(sums)

    def p(g):
        if not g:
            return 1 / size
        table, cut, sums = tables[len(g) - 1], cuts[len(g) - 1], contexts[len(g) - 1]
        if g[:-1] not in sums:
            return p(g[1:])
        total, left = sums[g[:-1]]
        own = (table[g] - cut[min(table[g], 3) - 1]) / total if g in table else 0
        return own + left / total * p(g[1:])

    return lambda text: -sum(np.log2(p(g)) for g in slices(text))


def test_quality_documents_wait_for_their_bits(spark, monkeypatch):
    """Documents are written once, in small rows, and only the bits of their n-grams are shuffled to them."""
    monkeypatch.setattr(quality, "FLUSH", 2000)
    monkeypatch.setattr(quality, "BATCH", 500)
    table = spark.createDataFrame([(i, said(i, 40)) for i in range(60)], "doc_id bigint, text string").coalesce(1)
    levels = quality.kneser_ney(quality.count_grams(table.select("text"), S.BYTES), S.BYTES)
    plan = quality.score(table, levels, S.BYTES)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(asking" in plan and "hashpartitioning(block" not in plan
    blocks = quality.in_blocks(table, S.BYTES)
    assert blocks.select("block").distinct().count() == 1 and blocks.where("packed is not null").count() > 5
    assert blocks.selectExpr("max(size(grams))").first()[0] == 500
    grams = [g for r in blocks.where("grams is not null").collect() for g in r["grams"]]
    assert len(grams) == len(set(grams)) and not spark.catalog.listTables()


def test_quality_takes_workers_without_what_others_kept(spark, monkeypatch, tmp_path):
    """A token writer's pieces don't stay in the workers that a later classifier runs in."""
    sharing.kept_in_worker("pieces", lambda: 1)
    sharing.let_go_in_worker()
    assert sharing.kept_in_worker("pieces", lambda: 2) == 2
    sharing.let_go_in_worker()
    assert list(sharing.tidied(iter)([1, 2])) == [1, 2]
    for name, work in {"count": lambda t: quality.count_grams(t.select("text"), S.BYTES), "blocks": lambda t: quality.in_blocks(t, S.BYTES)}.items():
        monkeypatch.setattr(quality, "let_go_in_worker", (tmp_path / name).touch)
        work(spark.createDataFrame([(1, "a text")], "doc_id bigint, text string")).collect()
        assert (tmp_path / name).exists()


@pytest.mark.parametrize("block", [1 << 23, 300])
def test_quality_bits_are_those_of_a_dictionary(spark, monkeypatch, block):
    """Every n-gram of every text is joined with unfolded counts: letters 16 code points apart, capitals
    and digits differ, and texts that repeat, are empty or span blocks have their whole sum."""
    monkeypatch.setattr(quality, "BLOCK", block)
    trusted = [said(i, 12) for i in range(30)] + ["АБВ абв 123", "Aa 19"]
    texts = [*trusted, trusted[0], "", "РСТ рст 456", "aA 91", said(99, 200), "\x00\n🙂"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "other"), (None, "none")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    counts = quality.count_grams(table.where(f"doc_id < {len(trusted)} and text <> 'other'").select("text"), S.BYTES)
    got = quality.score(table, quality.kneser_ney(counts, S.BYTES), S.BYTES).collect()
    bits = kneser_ney_bits(trusted, S.BYTES)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_symbols"]) for r in got if r["doc_id"] is not None) == sorted(
        (False, i, len(t.encode()) + 1) for i, t in rows if i is not None
    )
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append(bits(t))
    found = collections.defaultdict(list)
    for r in got:
        found[r["doc_id"]].append(r["bits"])
    assert all(np.allclose(sorted(found[i]), sorted(want[i]), rtol=1e-5) for i in want) and len(got) == len(rows)
    assert bits("aA 91") > bits("Aa 19") + 5


def test_language_uses_all_evidence(spark):
    texts = {"en": "the house and the garden are near the river", "de": "das haus und der garten sind nahe am fluss"}
    known = docs(spark, [(i, t + f" {i}", lang, "a") for i in range(30) for lang, t in texts.items()])
    page = '<html lang="{}"><style>p{{}}</style><p>{}</p></html>'
    rows = [(i, f"http://h{i % 2}.example.{'de' if i % 2 else 'com'}/x", page.format(("en", "de")[i % 2], texts[("en", "de")[i % 2]])) for i in range(40)]
    rows += [(100, "http://h1.example.de/y", page.format("de", "")), (101, None, None)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, belief int")
    got = {r["page_id"]: r for r in language.identify_languages(pages, known).collect()}
    assert all(got[i]["lang"] == ("en", "de")[i % 2] for i in range(40)) and got[100]["lang"] == "de" and got[101]["lang"]
    assert language.identify_languages(pages, known.where("false")).first()["lang"] is None


def test_empty_tables(spark, odd):
    none = odd.where("false")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert not jaccard.near_duplicates(none).collect() and not line_dedup.drop_shared_lines(none).collect()
    assert not mixing.mix_sources(none).collect() and not quality.judge_quality(none, labels).collect()
    assert not toxicity.score_toxicity(none, labels).collect() and not decontaminate.find_contamination(odd, bench).collect()
    assert not decontaminate.find_contamination(none, bench).collect()
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert not ann.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0).collect()
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert not chat.read_turns(chat.format_chat(turns)).collect()
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert not language.identify_languages(pages, odd).collect()


def test_empty_token_files(spark, odd, tmp_path):
    import public_tokenizers

    token_files.write_token_files(odd.where("false"), str(tmp_path / "t"), str(public_tokenizers.path("word_bpe_49k.json")), 1)
    assert not token_files.read_token_files(spark, str(tmp_path / "t")).collect()


def test_word_pattern_of_sizes(spark):
    texts = ["a b\tc", "", None, " x y\x0bz", " "]
    rows = docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
