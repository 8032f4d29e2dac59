"""Training-data operators against brute force, and their behaviour on odd tables."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlog.llm import extraction, fingerprints, mixing, ngram_join, packing, quality_model, quality_rules, substring, threads, toxicity
from strandlog.llm.queries import QUERIES

from ..session import DATA, spark
from . import pages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents():
    """Nulls everywhere, empty and long texts, repeated rows, ties, and extra columns whose names the operators use."""
    long = " ".join(f"word{i % 977} w{i}" for i in range(30_000))
    texts = [None, "", "   \n\t ", "one", "a b c d e", "Straße größer 日本 — naïve", "same text here " * 9, "same text here " * 9, long, long + " more", "<|endoftext|> tail", "x" * 40_000]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[8], (None, "same text here " * 9, None, None, 1), (None, None, None, None, None), (-5, "negative id", "de", "src1", 11)]
    df = spark().createDataFrame(rows, DOCS)
    for name in ("kept", "copies", "row", "id", "n", "size", "run", "rank", "key", "block", "fp", "_id", "_copy", "doc", "place", "part"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty_documents():
    return spark().createDataFrame([], DOCS)


def documents():
    return spark().read.parquet(f"{DATA}/sf0.001/documents.parquet")


def labels():
    return spark().read.parquet(f"{DATA}/sf0.01/labels.parquet")


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held(row, name="doc_id"):
    return -1 if row[name] is None else row[name]


def check_packs(docs, found):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path())
    expected = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        expected[r["doc_id"]].append([*encode.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    got = defaultdict(list)
    for r in found:
        got[r["doc_id"]].append(r)
    assert set(got) == set(expected)
    for key, lists in expected.items():
        want = sorted((s, min(2048, len(ids) - s), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for ids in lists for s in range(0, len(ids), 2048))
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got[key]) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(r["length"] for r in found) / (2048 * len(sequences))


def test_packing_against_the_tokenizer():
    docs = documents()
    assert check_packs(docs, packing.pack(docs, tokenizer_path()).collect()) > 0.95
    odd = odd_documents()
    check_packs(odd, packing.pack(odd, tokenizer_path()).collect())
    assert packing.pack(empty_documents(), tokenizer_path()).count() == 0


@pytest.mark.parametrize("run", [" " * 1_000_001, "\n" * 1_000_001, "\x85" * 1_000_001, "\t \n" * 400_000, " " * 99_999 + "b" + " " * 100_001, "b" * 2_000_001, "!" * 1_000_001], ids=range(7))
def test_packing_of_very_long_runs(run):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path())
    for text in (f"a{run}b", run):
        assert packing.encoder(tokenizer_path())(text) == encode.encode(text, add_special_tokens=False).ids


def test_packing_of_special_tokens_in_a_text():
    from tokenizers import Tokenizer

    plain, as_text = Tokenizer.from_file(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    as_text.encode_special_tokens = True
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext|", "日本 <|endoftext|>", " <|endoftext|>  é"):
        for flag, one in ((False, plain), (True, as_text)):
            assert packing.encoder(tokenizer_path(), flag)(text) == one.encode(text, add_special_tokens=False).ids
    assert packing.encoder(tokenizer_path())("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_shortest_pack_first_uses_every_piece_once():
    histogram = {2048: 3, 1500: 4, 700: 5, 548: 2, 100: 40, 1: 7}
    found = packing.patterns(histogram, 2048)
    used = defaultdict(int)
    for lengths, count in found:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += count
    assert used == histogram


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    where = defaultdict(list)
    for i in range(len(words) - 7):
        where[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed


@pytest.mark.parametrize("source", [documents, odd_documents, empty_documents])
def test_quality_rules_base(source):
    docs = source()
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(brute_quality(r["text"]))
    got = defaultdict(list)
    for r in quality_rules.judged(docs).collect():
        got[r["doc_id"]].append((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]))
        assert not (r["base_failed"] and r["kept"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}


def test_line_rules():
    fails = lambda line: quality_rules.line_fails(line.encode(), line.encode().split())
    assert fails("Home") and fails("Home | About | Contact | Help | Terms of this site") and fails("We use cookies to make this site better for you.")
    assert not fails("The committee met on Tuesday and agreed on the plan for next year.") and not fails("“Yes.”")


def shingle_set(text):
    words = WORD.findall(text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_classes(rows):
    """{text: (class id, links)} by comparing all pairs of different texts."""
    ids = {}
    for doc, text in rows:
        if doc is not None:
            ids[text or ""] = min(doc, ids.get(text or "", doc))
        else:
            ids.setdefault(text or "", None)
    texts = list(ids)
    sets = [shingle_set(t) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                common = len(a & b)
                if common >= 0.8 * (len(a) + len(b) - common) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    heads = defaultdict(list)
    for i, t in enumerate(texts):
        if ids[t] is not None:
            heads[find(i)].append(ids[t])
    return {t: (min(heads[find(i)], default=None), links[i]) for i, t in enumerate(texts)}


def test_jaccard_join_against_all_pairs():
    docs = spark().read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    expected = brute_classes(rows)
    texts = dict(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect()}
    true = {k: expected[t or ""] for k, t in rows}
    links = sum(n for _, n in true.values())
    found = sum(min(v[1], true[k][1]) for k, v in got.items())
    assert len(got) == len(rows) and found / links >= 0.99
    assert all(v[1] <= true[k][1] for k, v in got.items())  # what is verified is never wrong
    assert all(v == true[k] for k, v in got.items() if not true[k][1])
    kept = {r["doc_id"] for r in ngram_join.one_of_each(docs).collect()}
    assert kept == {k for k, v in got.items() if v[0] == k}


def test_jaccard_join_on_odd_tables():
    docs = odd_documents()
    found = ngram_join.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    expected = brute_classes([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    by_id = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None}
    for r in found:
        if r["doc_id"] is not None:
            assert (r["class_id"], r["n_links"]) == expected[by_id[r["doc_id"]] or ""]
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2
    assert ngram_join.near_duplicates(empty_documents()).count() == 0


def test_one_of_each_with_different_texts_of_one_id():
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    rows = [(1, a), (5, a + " end"), (5, b), (5, b), (7, b + " end"), (8, c), (8, c + " end"), (9, c), (None, c)]
    kept = ngram_join.one_of_each(spark().createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"] or 0, r["text"][0]) for r in kept)
    assert found == [(0, "c"), (1, "a"), (5, "b"), (8, "c")]


def test_jaccard_join_with_a_large_group():
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(i, f"{base} t{i}") for i in range(700)]  # all alike, more than two blocks
    found = ngram_join.near_duplicates(spark().createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["class_id"], r["n_links"]) for r in found} == {(0, 699)}


def test_jaccard_join_finds_the_true_pairs_near_the_threshold():
    rng, rows = np.random.default_rng(9), []
    for k in range(250):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for copy in range(4):
            own = list(base)
            for at in rng.integers(0, 200, copy + int(rng.integers(0, 2))):
                own[at] = f"n{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    expected = brute_classes(rows)
    found = ngram_join.near_duplicates(spark().createDataFrame(rows, "doc_id long, text string")).collect()
    true = sum(expected[t][1] for _, t in rows)
    hits = sum(min(r["n_links"], expected[dict(rows)[r["doc_id"]]][1]) for r in found)
    print("true pairs", true // 2, "recall", hits / true)
    assert true > 1000 and hits / true >= 0.995


def test_jaccard_join_with_small_blocks(monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4000)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: int(rng.integers(100, 121))], *(f"t{i}x{k}" for k in range(int(rng.integers(0, 12))))])) for i in range(90)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    expected = brute_classes(rows)
    found = ngram_join.near_duplicates(spark().createDataFrame(rows, "doc_id long, text string")).collect()
    assert all((r["class_id"], r["n_links"]) == expected[dict(rows)[r["doc_id"]]] for r in found)


def test_components_with_a_hub():
    from strandlog.llm import graph

    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)] + [(59, 500), (500, 501), (140, 139), (7, 7)]
    found = {r["node"]: r["root"] for r in graph.components(spark().createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in [*range(60), 500, 501]}, **{i: 100 for i in range(100, 141)}}


def test_quality_classifier_on_held_out_rows():
    docs = spark().read.parquet(f"{DATA}/sf0.01/documents.parquet")
    found = QUERIES["op4_quality_classifier"](spark(), f"{DATA}/sf0.01").join(labels(), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) / len(found) > 0.85
    model = quality_model.train(docs, labels())
    odd = quality_model.scored(odd_documents(), model).collect()
    assert len(odd) == odd_documents().count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in odd)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in odd if r["doc_id"] is not None)
    assert quality_model.scored(empty_documents(), model).count() == 0
    assert quality_model.kept(odd_documents(), model).columns == odd_documents().columns
    assert quality_model.scored(documents(), quality_model.train(docs, labels().limit(0))).count() == 200


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality_model.fit(x, y).scores(x) >= 0.5) == y).mean() > 0.9


# Rude words of the given documents; the operator does not know them.
RUDE = "clown disgusting idiot loser moron pathetic scum stupid trash worthless".split()


def test_toxicity_on_held_out_rows():
    docs = spark().read.parquet(f"{DATA}/sf0.01/documents.parquet")
    chain = toxicity.train(docs, labels())
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rude = set(RUDE)
    found = toxicity.scored(docs, chain).collect()
    clear = {k: any(w in rude for w in re.findall(r"[a-z]+", t.lower())) for k, t in texts.items()}
    caught = [r["toxic"] for r in found if r["held_out"] and clear[r["doc_id"]]]
    clean = [r["toxic"] for r in found if r["held_out"] and not clear[r["doc_id"]]]
    assert sum(caught) / len(caught) > 0.8 and sum(clean) / len(clean) < 0.06
    odd = toxicity.scored(odd_documents(), chain).collect()
    assert len(odd) == odd_documents().count() and all(0 <= r["toxic_score"] <= 1 for r in odd)
    assert toxicity.scored(empty_documents(), chain).count() == 0
    assert {r["toxic_score"] for r in toxicity.scored(documents(), toxicity.train(docs, labels().limit(0))).collect()} == {0.5}


def held_out_recall(found, known):
    """(toxic held-out texts caught, of how many; clean ones taken for toxic, of how many), by the label."""
    rows = found.where("held_out").join(known.withColumnRenamed("toxic", "y"), "doc_id").select("toxic", "y").collect()
    caught, clean = ([r["toxic"] for r in rows if r["y"] == y] for y in (1, 0))
    return sum(caught), len(caught), sum(clean), len(clean)


def test_toxicity_learns_words_from_the_labels():
    docs, known = (spark().read.parquet(f"{DATA}/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    other = docs
    for k, word in enumerate(RUDE):
        other = other.withColumn("text", F.regexp_replace("text", rf"(?i)\b{word}\b", f"qvorz{k}x"))
    for texts in (docs, other):
        chain = toxicity.train(texts, known)
        found = toxicity.scored(texts, chain).cache()
        caught, toxic, wrong, clean = held_out_recall(found, known)
        assert toxic and caught / toxic > 0.8 and wrong / clean < 0.06
        assert found.where("first_group >= 0.5").count() and found.where("second_group >= 0.5").count()


def test_clusters_follow_the_texts_that_buckets_share():
    x = np.zeros((60, 5), np.float32)
    x[0:10, 0] = x[5:15, 1] = x[20:30, 2] = x[25:35, 3] = x[40:60, 4] = 1
    y = (np.arange(60) < 40).astype(float)
    assert [c.tolist() for c in toxicity.clustered(x, y, np.array([9.0, 8, 7, 6, -5]), 2)] == [[0, 1], [2, 3]]
    assert [len(c) for c in toxicity.clustered(x, y, np.array([9.0, -8, -7, -6, -5]), 2)] == [1, 0]
    assert [len(c) for c in toxicity.clustered(x[:, :0], y, np.zeros(0), 2)] == [0, 0]


def test_chain_passes_earlier_categories_on():
    x = np.eye(2)[[0, 1] * 200].astype(np.float32)
    first = (np.arange(400) % 2 == 0).astype(float)
    chain = toxicity.fit_chain(x, np.column_stack([first, first]), np.array([3, 9], np.int32), np.arange(400) % 3)
    assert len(chain.weights[1]) == 4 and chain.weights[1][2] > 0
    assert ((chain.probabilities(x) >= 0.5) == first[:, None]).all()


def messages(rows):
    return spark().createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_threads_follow_quotes():
    rows = [
        (1, 0, "user", "How do I sort a list?\nAnd how do I reverse it?"),
        (1, 1, "assistant", "Use sorted for that."),
        (1, 2, "user", "On Monday the user wrote:\n> And how do I  REVERSE it?\nI meant this one."),
        (1, 3, "assistant", "> > And how do I reverse it?\n> I meant this one.\nUse reversed."),
        (1, 4, "user", "> Use sorted for that.\nThanks for the first."),
        (1, 5, "assistant", "You are welcome."),
        (1, 6, "user", "> nobody said this\nA new thought."),
        (2, 0, "user", "And how do I reverse it?"),
    ]
    found = {(r["conv_id"], r["turn"]): r for r in threads.reply_ordered(messages(rows)).collect()}
    parents = {k: r["parent_turn"] for k, r in found.items()}
    assert parents == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 2, (1, 4): 1, (1, 5): 4, (1, 6): 5, (2, 0): None}
    assert [found[1, t]["linked"] for t in range(7)] == [False, False, True, True, True, False, False]
    assert [t for _, t in sorted((found[1, t]["position"], t) for t in range(7))] == [0, 1, 4, 5, 6, 2, 3]
    assert found[1, 2]["text"] == "I meant this one." and found[1, 3]["text"] == "Use reversed." and found[1, 6]["text"] == "A new thought."
    assert found[1, 3]["n_quoted"] == 2 and found[1, 6]["n_linked"] == 0


def test_threads_follow_quotes_that_were_wrapped_again():
    first = "The old press in the cellar needs a new belt before winter.\nIts motor runs warm, and nobody knows why it does."
    second = "Thanks.\nI looked at the motor today and found that the fan had come loose. It is fixed now. The belt is on order and should be here by Monday next week."
    rows = [
        (1, 0, "a", first),
        (1, 1, "b", second),
        (1, 2, "c", "Unrelated: the meeting room is locked."),
        (1, 3, "a", "On Tuesday b wrote:\n> I looked at the motor today\n> and found that the fan had\n> come loose. It is fixed now.\nGood."),
        (1, 4, "c", "> The old press in the cellar\n> needs a new belt before\n> winter. Its motor runs warm, and\n> nobody knows why it does.\nI can help."),
        (1, 5, "d", "> On Tuesday b wrote:\n>> The belt is on order and\n>> should be here by Monday next\n>> week.\n> Good.\nFine with me."),
        (1, 6, "b", "> I can\n> help.\nPlease do."),
        (1, 7, "b", "> Please\n> come at noon on Friday with a ladder.\nNo."),
    ]
    found = {r["turn"]: r for r in threads.reply_ordered(messages(rows)).collect()}
    assert {t: r["parent_turn"] for t, r in found.items()} == {0: None, 1: 0, 2: 1, 3: 1, 4: 0, 5: 3, 6: 4, 7: 6}
    assert [found[t]["linked"] for t in range(8)] == [False, False, False, True, True, True, True, False]
    assert found[5]["n_quoted"] == found[5]["n_linked"] == 2 and found[5]["text"] == "Fine with me."
    assert [r["turn"] for r in sorted(found.values(), key=lambda r: r["position"])] == brute_order({t: r["parent_turn"] for t, r in found.items()})


def test_threads_of_a_very_long_message():
    text = " ".join(f"w{i}" for i in range(60_000))
    quote = "\n".join("> " + " ".join(f"w{i}" for i in range(k, k + 9)) for k in range(30_000, 30_090, 9))
    rows = [(1, 0, "a", text), (1, 1, "b", "other"), (1, 2, "a", quote + "\nyes")]
    found = {r["turn"]: r for r in threads.reply_ordered(messages(rows)).collect()}
    assert found[2]["parent_turn"] == 0 and found[2]["linked"] and found[0]["text"] == text


def brute_order(parents):
    children = defaultdict(list)
    for t, p in parents.items():
        children[p].append(t)
    out, stack = [], [None]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(sorted(children[node], reverse=True))
    return out[1:]


def test_threads_of_a_long_conversation():
    rng = np.random.default_rng(3)
    rows, parents = [], {}
    for t in range(400):
        p = int(rng.integers(0, t)) if t and rng.random() < 0.4 else t - 1 if t else None
        parents[t] = p
        rows.append((7, t, "user", (f"> line of {p}\n" if p is not None else "") + f"line of {t}\nshared line"))
    found = threads.reply_ordered(messages(rows)).collect()
    assert {r["turn"]: r["parent_turn"] for r in found} == parents
    assert [r["turn"] for r in sorted(found, key=lambda r: r["position"])] == brute_order(parents)


def test_threads_on_odd_tables():
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 2, "user", ">"), (1, 3, "x", "> \n>\n" * 50)]
    df = messages(rows)
    for name in ("place", "key", "level", "segment", "_block", "parent", "lines"):
        df = df.withColumn(name, F.lit("clash"))
    found = threads.reply_ordered(df).collect()
    assert len(found) == len(rows)
    assert sorted(r["position"] for r in found if r["conv_id"] == 1) == [0, 1, 2, 3, 4]
    assert threads.reply_ordered(messages([])).count() == 0


def exact(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y) if x or y else 1.0


@pytest.mark.parametrize("source", [documents, empty_documents])
def test_fingerprints_against_exact_similarity(source):
    docs = source()
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in fingerprints.with_neighbours(docs).collect()}
    assert len(got) == len(rows)
    errors, prints = [], defaultdict(set)
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [abs(r["near_edited"] - exact(text, edited)), abs(r["near_next"] - exact(text, after))]
        prints[text].add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())
    assert not errors or np.mean(errors) < 0.03 and max(errors) < 0.2


def test_fingerprints_on_odd_tables():
    docs = odd_documents()
    found = fingerprints.with_neighbours(docs).collect()
    assert len(found) == docs.count() and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in found)
    one = fingerprints.with_neighbours(docs.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.fingerprint(docs).count() == docs.count()


def test_fingerprints_of_hot_ids(monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN_BYTES", 300)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i} of many " + "w " * (i % 11)) for i in range(300)]
    docs = spark().createDataFrame(rows, "doc_id long, text string")
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"]) for r in docs.select("*", F.xxhash64("text").alias("h")).collect()))
    expected = []
    for k, (known, doc, _, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)][3], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        expected.append((doc if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    found = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.with_neighbours(docs).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>A &amp; B&nbsp;c</h1><p>First   paragraph
with <a href="x">a link</a>.<p>Second &lt;one&gt;.<aside>Related</aside><ul><li>Point</ul><form><label>Mail</label><input></form><!-- no --><p>Last &#x41;.</article>
<section id="comments"><article><p>I disagree with all of this, and here is a long comment about why.</p></article></section><div class="sidebar">More to read here today</div><footer>&copy; 2020</footer></body></html>"""


def test_extraction_of_a_page():
    assert extraction.main_text(PAGE) == "A & B c\nFirst paragraph with a link.\nSecond <one>.\nPoint\nLast A."
    assert extraction.main_text("") == "" and extraction.main_text("<p") in ("", "<p") and extraction.main_text("<script>never closed") == ""
    plain = "".join(f"<p>{'A sentence of several plain words. ' * 6}</p>" for _ in range(4))
    assert extraction.main_text(f"<body><div><a href=x>Home</a></div>{plain}<div><a href=y>Imprint</a></div></body>").count("\n") == 3


def long_text(k):
    return " ".join(f"word{k} of a sentence" for _ in range(15))


@pytest.mark.parametrize(
    "body, kept",
    [
        # paragraphs before links, in an article and without one
        ("<article><p>{0}</p><p>{1}</p><ul><li><a href=x>Share</a></li><li><a href=y>Next</a></li></ul></article>", (0, 1)),
        ("<div><p>{0}</p><p>{1}</p></div><div><a href=x>Previous</a></div><div><a href=y>Next</a></div>", (0, 1)),
        ("<article><p>{0}</p><p><a href=x>related link</a></p><p><a href=y>other link</a></p></article>", (0,)),
        # menu items before text
        ("<div><a href=x>Home</a></div><div><a href=y>About us</a></div><div><p>{0}</p><p>{1}</p></div>", (0, 1)),
        ("<div><div><a href=x>{2}</a></div><p>{0}</p></div>", (0,)),
        # mislabelled zones: main words win, whole names count, long text in a doubtful zone stays
        ("<div class='main ad-free share'><p>{0}</p><p>Short line here.</p><p>{1}</p></div>", "all"),
        ("<div id='search-for-meaning'><p>{0}</p><p>{1}</p></div>", (0, 1)),
        ("<div class='promo'><p>{0}</p><p>{1}</p></div>", (0, 1)),
        # furniture stays furniture
        ("<article><p>{0}</p></article><div class='cookie-banner'><p>We use cookies on this site.</p></div>", (0,)),
        ("<div class='main-nav'><p>Choose a section of ours</p></div><article><p>{0}</p></article>", (0,)),
        ("<article><p>{0}</p></article><div class='comment-list'><p>{1}</p></div><footer><p>{2}</p></footer>", (0,)),
        ("<div><p>{0}</p><p>{1}</p></div><div>Share this</div><div><a href=x>Mail</a></div><div>Copyright of the publisher, all rights reserved in every country</div>", (0, 1)),
    ],
)
def test_extraction_uses_a_blocks_own_words_and_links(body, kept):
    texts = [long_text(k) for k in range(3)]
    want = [texts[0], "Short line here.", texts[1]] if kept == "all" else [texts[k] for k in kept]
    assert extraction.main_text(f"<html><body>{body.format(*texts)}</body></html>").split("\n") == want


@pytest.mark.parametrize("shape", pages.SHAPES)
def test_extraction_by_page_shape(shape):
    precision, recall = pages.quality(extraction.main_text, shape, range(100, 200))
    assert precision > 0.99 and recall > 0.99


LONG = " ".join(f"word{k} goes here" for k in range(20)) + "."


@pytest.mark.parametrize(
    "body, kept",
    [
        ("<article><p>{0}</p></article><footer><a href=x>Home</a> <a href=y>Help</a></footer>", [LONG]),
        ("<div><p>{0}</p></div><ul><li><a href=x>Home</a><li><a href=y>Help</a></ul>", [LONG]),
        ("<div><a href=a>Home</a> <a href=b>News</a> <a href=c>Shop</a></div><div><p>{0}</p></div>", [LONG]),
        ("<article><p>{0}</p><p>See</p><p><a href=x>this linked line</a></p></article>", [LONG, "See", "this linked line"]),
        ("<p>Short line.</p><p>Another one here.</p><p>It ends.</p>", ["Short line.", "Another one here.", "It ends."]),
        ("<article><p>{0}</p></article><a href=x><div>Card</div></a><a href=y><div>Another card of this site.</div></a>", [LONG]),
        ("<article><section class=discussion><h2>Discussion</h2><p>{0}</p></section></article>", ["Discussion", LONG]),
        ("<p><a href=x>never closed <p>{0}<p>{0}", [LONG, LONG]),
        ("<form><p>{0}</p></form><article class=comment><p>{0}</p></article>", [LONG]),
        ("<p class=notice>A short notice of the site.</p><p>{0}</p>", [LONG]),
        ("<article><h1>T</h1><table><tr><td>a<td>12<tr><td>b<td>7</table></article>", ["T", "a", "12", "b", "7"]),
    ],
)
def test_extraction_of_single_layouts(body, kept):
    assert extraction.main_text(f"<html><body>{body.format(LONG)}</body></html>").split("\n") == kept


def test_extraction_of_the_given_pages():
    import html

    given = spark().read.parquet(f"{DATA}/sf0.01/pages.parquet")
    for r in extraction.extracted(given).join(given.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1]
        blocks = [re.sub(r"<[^>]*>", " ", x) for x in re.split(r"</?(?:h1|p)>", article)]
        expected = [x for x in (re.sub(r"[ \t\n\f\r\v]+", " ", html.unescape(x)).strip(" ") for x in blocks) if x]
        assert r["text"] == "\n".join(expected) and r["n_chars"] == len(r["text"])
    odd = spark().createDataFrame([(1, None, None), (None, "u", ""), (1, "u", "<p>" * 3000 + "x"), (2, "u", "<a" * 20_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert extraction.extracted(odd).count() == 4


def test_mixing_on_odd_tables():
    docs = odd_documents()
    found = mixing.mixed(docs).collect()
    assert len(found) == docs.count()
    taken, target = defaultdict(int), {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert abs(sum(target.values()) - sum({r["source_size"]: r["source_size"] for r in found}.values())) < 1e-6
    again = mixing.repeated(docs)
    copies = defaultdict(list)
    for r in found:
        copies[r["doc_id"]].append(round(r["taken"] / r["size"]) if r["size"] else 0)
    assert again.columns == docs.columns and again.count() == sum(len(x) * max(x) for x in copies.values())  # rows that share an id go alike
    assert mixing.mixed(empty_documents()).count() == 0


def test_mixing_comes_near_its_targets():
    found = QUERIES["op9_mixing"](spark(), f"{DATA}/sf0.01").join(spark().read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect():
        assert abs(r["taken"] - r["target"]) <= 2 * r["largest"] + 1


def brute_substring(rows):
    """[(doc_id, n_words, n_removed, sha)] of rows (doc_id, text)."""
    first = {}
    for doc, text in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - 12) if doc is not None else ():
            key = tuple(words[i : i + 13])
            first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        gone = {i + k for i in range(len(words) - 12) if doc is not None and first[tuple(words[i : i + 13])] < doc for k in range(13)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup_on_odd_tables():
    docs = odd_documents()
    passage = " ".join(f"p{i}" for i in range(60))
    more = [(100 + i, f"own{i} {passage} end{i}\n\nlast{i}", None, None, 1) for i in range(300)] + [(100, f"{passage} {passage}", None, None, 1)]
    docs = docs.select(*empty_documents().columns).union(spark().createDataFrame(more, DOCS)).withColumn("kept", F.lit("clash")).withColumn("hits", F.lit(1))
    found = substring.deduplicated(docs).collect()
    expected = brute_substring([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=repr) == expected
    cleaned = substring.without_repeats(docs)
    assert cleaned.columns == docs.columns
    assert cleaned.where("doc_id = 200").first()["text"] == "own100 end100 last100"
    assert substring.deduplicated(empty_documents()).count() == 0


def test_index_over_batches_equals_one_batch():
    docs = documents()
    key = lambda r: repr(r)
    rows = lambda n: sorted((tuple(r) for r in substring.deduplicated(docs, batches=n).drop("kept").collect()), key=key)
    assert rows(4) == rows(1)


@pytest.mark.parametrize("size", [1, 3, 64])
def test_blocks_that_span_arrow_batches(size):
    texts = ["a" * (i * 37 % 50) for i in range(64)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(substring, "BLOCK_BYTES", 100)
        patch.setattr(substring, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 2)}))}))
        batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(a, min(a + size, 64))), "text": texts[a : a + size]}) for a in range(0, 64, size)]
        found = [tuple(r.values()) for b in substring._numbered(3)(iter(batches)) for r in b.to_pylist()]
    total, expected, seen = 0, [], {}
    for i, t in enumerate(texts):
        block = (3 << 48 | 2 << 24) + total // 100
        expected.append((block, seen.setdefault(block, 0), i, t))
        seen[block] += 1
        total += len(t)
    assert found == expected


def test_an_index_that_stays_takes_batch_after_batch():
    docs = documents().select("doc_id", "text")
    path = tempfile.mkdtemp(prefix="spark-")
    index = substring.FingerprintIndex(spark(), f"{path}/index", buckets=3)
    parts = [docs.where("doc_id < 60"), docs.where("doc_id between 60 and 119"), docs.where("doc_id >= 120")]
    found = index.append(parts[0]).collect() + index.append(parts[1]).collect()
    index.compact(2)
    assert len(index.prints) == 1 and len(index.texts) == 2
    index.close()
    again = substring.FingerprintIndex(spark(), f"{path}/index")  # opened again, the merged run is what the third batch meets
    assert again.buckets == 3 and len(again.prints) == 1 and len(again.texts) == 2
    found += again.append(parts[2]).collect()
    expected = substring.deduplicated(docs, batches=1).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected))
    late = spark().createDataFrame([(-1, docs.orderBy(F.desc(F.length("text"))).first()["text"])], "doc_id long, text string")
    row = again.append(late).first()  # history comes first, whatever the id
    assert row["n_words"] == row["n_removed"] > 13
    again.drop()
    assert not os.path.exists(f"{path}/index")


def test_a_window_of_more_blocks_than_deal(monkeypatch):
    monkeypatch.setattr(substring, "DEAL", 3)
    monkeypatch.setattr(substring, "BLOCK_BYTES", 2000)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"own{i} a{i} {passage} end{i} " + " ".join(f"x{i % 7}y{k}" for k in range(40))) for i in range(120)]
    found = substring.deduplicated(spark().createDataFrame(rows, "doc_id long, text string"), batches=2).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=repr) == brute_substring(rows)
