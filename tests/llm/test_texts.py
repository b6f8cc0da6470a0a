"""Quality, toxicity, leaks and surrogates."""

import ipaddress
import random
import re
import zlib

from pyspark.sql import functions as F

from forecourt.llm import decontaminate, quality, surrogates, toxicity


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    judged = quality.judge_quality(docs, labels.filter(~held)).join(labels.filter(held).withColumnRenamed("quality", "truth"), "doc_id").collect()
    assert sum(r["kept"] == (r["truth"] == 1) for r in judged) >= 0.97 * len(judged)
    assert all(r["kept"] for r in judged if r["truth"] == 1)


def test_sparse_sites_shrink_toward_their_parents(spark, documents, labels):
    rows = quality.judge_quality(documents, labels).collect()
    assert len({r["source"] for r in rows}) > 1
    for r in rows:
        assert 0 < r["site_quality"] < 1 and 0 < r["path_quality"] < 1 and 0 <= r["quality"] <= 1


def test_quality_of_odd_rows(spark, odd_documents, no_documents, labels):
    labels = spark.createDataFrame([(1, 1), (5, 1), (6, 0), (7, 0), (8, 1), (8, 1), (None, 0), (1, None)], "doc_id long, quality int")
    out = quality.judge_quality(odd_documents, labels, carry=tuple(odd_documents.columns))
    assert len(set(out.columns)) == len(out.columns)
    rows = out.select("text", "evidence", F.col("kept")).collect()
    assert len(rows) == odd_documents.count()
    assert all(not r["kept"] for r in rows if not (r["text"] or "").strip())
    assert quality.judge_quality(no_documents, labels).count() == 0
    assert all(r["kept"] for r in quality.judge_quality(odd_documents, labels.limit(0)).collect())


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs, labels).join(labels.select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    caught = [r for r in held if r["predicted"]]
    assert sum(r["truth"] for r in caught) >= 0.97 * len(caught)
    assert sum(r["truth"] for r in caught) >= 0.85 * sum(r["truth"] for r in held)


def test_interactions_are_learned():
    import numpy as np

    random = np.random.default_rng(6)
    x = random.integers(0, 2, (2000, 2))
    labels = (x[:, 0] & x[:, 1]).astype(float) * (random.random(2000) < 0.95)
    machine = toxicity.Machine(np.ones(2**toxicity.BITS, dtype=bool))
    ids = np.concatenate([np.flatnonzero(r) for r in x]).astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(x.sum(axis=1))])
    machine.fit(ids, np.ones(len(ids), dtype=np.float32), starts, labels)
    logit, _ = machine.logits(np.array([0, 1, 0, 1]), np.ones(4, dtype=np.float32), np.array([0, 1, 2, 4]))
    assert logit[0] < 0 and logit[1] < 0 < logit[2]


def test_terms_that_are_neutral_alone(spark):
    """A word in 20 % toxic texts, like all others, is told by its company: an insult beside a group."""
    import random

    draw = random.Random(9)
    common = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    kinds = [("wretchy", "zanders")] + [("wretchy",)] * 4 + [("zanders",)] * 4 + [("scumbagq",)] * 4 + [()] * 12
    rows = []
    for i in range(4000):
        words = [draw.choice(common) for _ in range(8)] + list(kinds[i % 25])
        draw.shuffle(words)
        rows.append((i, " ".join(words), int(i % 25 in (0, 9, 10, 11, 12))))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    held = [r for r in toxicity.score_toxicity(docs, labels).collect() if r["held_out"]]
    both = [r["predicted"] for r in held if r["doc_id"] % 25 == 0]
    one = [r["predicted"] for r in held if 1 <= r["doc_id"] % 25 <= 8]
    assert len(both) > 20 and sum(both) >= 0.9 * len(both) and sum(one) <= 0.05 * len(one)


def test_toxicity_of_odd_rows(odd_documents, no_documents, labels):
    rows = toxicity.score_toxicity(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert toxicity.score_toxicity(no_documents, labels).count() == 0
    assert {r["predicted"] for r in toxicity.score_toxicity(odd_documents, labels.limit(0)).collect()} == {0}


def _plain(text):
    return " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "


def test_leaks_equal_whole_passages(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], _plain(r["text"])) for r in bench.collect()]
    truth = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in _plain(r["text"])}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()} == truth
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in truth}


def test_paraphrases_with_their_answer(spark, documents):
    question = "Which of the seven wandering merchants carried silver lanterns across the frozen northern valley at midnight?"
    answer = " It was old Marcel from Granada."
    edited = "So, which of those seven merchants once carried some silver lanterns over the frozen valley at about midnight? It was old Marcel from Granada."
    filler = " ".join(documents.first()["text"].split()[:60])
    bench = spark.createDataFrame([(7, question + answer), (8, None), (9, ""), (None, "x y z"), (10, "12 34")], "item_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, f"{filler} {edited} {filler}"), (-2, filler), (-3, None)], "doc_id long, text string"))
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()] == [(-1, 7)]


def test_leaks_of_odd_rows(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the river bank."), (2, " ".join(f"w{i * i % 9973}" for i in range(100, 400)).replace("w", "ab"))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(odd_documents, bench).collect()] == [(1, 1)]
    assert decontaminate.find_leaks(no_documents, bench).count() == 0
    assert decontaminate.find_leaks(odd_documents, bench.limit(0)).count() == 0
    assert decontaminate.clean_documents(odd_documents, bench.limit(0)).count() == odd_documents.count()


def _planted(documents, n, seed=4):
    """Short runs of the documents' words, and documents that hold some of them between other words."""
    import random

    draw = random.Random(seed)
    words = [r["text"].split() for r in documents.filter("text IS NOT NULL").orderBy("doc_id").collect()]
    words = [w for w in words if len(w) > 200]
    items, texts = [], []
    for i in range(n):
        own, other = draw.sample(words, 2)
        at, size = draw.randrange(len(own) - 30), draw.randint(15, 25)
        items.append((i, " ".join(own[at : at + size])))
        place = draw.randrange(100)
        texts.append((i, " ".join(other[place : place + 60] + own[at : at + size] + other[place + 60 : place + 120])))
    return items, texts


def test_short_items_of_a_large_benchmark(spark):
    items, texts = _planted(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(3000), 1500)
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert [i for i, _ in items if (i, i) not in found] == []


def test_meetings_hold_every_leak():
    """Against the comparison of every window with every passage."""
    import numpy as np
    import pyarrow as pa

    random = np.random.default_rng(8)
    word = lambda: "abcdefghijklmnopqrstuvwxyz"[min(int(random.exponential(4)), 25)] * int(random.integers(1, 4))
    items = [" ".join(word() for _ in range(random.integers(1, 30))) + ". " + " ".join(word() for _ in range(4)) for _ in range(60)]
    texts = []
    for i in range(60):
        kept = [w for w in items[i].split() if random.random() < 0.8]
        texts.append(" ".join([word() for _ in range(random.integers(0, 90))] + kept + [word() for _ in range(random.integers(0, 90))]))
    batch = next(decontaminate._item_passages(iter([pa.RecordBatch.from_pydict({"item_id": list(range(60)), "text": items})])))
    words, answers = ([[w % 2**64 for w in x] for x in batch.column(c).to_pylist()] for c in ("words", "answer"))
    idf = np.abs(random.normal(3, 1, 2**decontaminate.BITS)).astype(np.float32)
    firsts = np.cumsum([0, *map(len, words)])
    bench = decontaminate.Benchmark(batch.column("item_id").to_pylist(), np.array(sum(words, []), np.uint64), firsts, [tuple(a) for a in answers], idf)
    (_, _, data, offsets), = decontaminate.split_portions(pa.array(texts))
    p = decontaminate.Passages(*decontaminate.word_hashes(data, offsets, decontaminate.NO_WORD), idf, bench)
    met, leaks = set(p.meetings(bench).tolist()), 0
    for run in np.flatnonzero(~p.lone).tolist():
        text, start = p.text[run], p.start[run]
        window = p.words[max(start - decontaminate.STRIDE, p.firsts[text]) : min(start + decontaminate.WINDOW + decontaminate.STRIDE, p.firsts[text + 1])].tolist()
        for b in range(60):
            share = bench.common(b, window)
            if share >= decontaminate.SUBSEQUENCE or share >= decontaminate.WITH_ANSWER and bench.answered(b, window):
                leaks += 1
                assert run * 60 + b in met
    assert leaks > 50


def test_short_items_delete_no_prose(spark, documents):
    prose = [
        (1, "He kept the boat in the shed, and who it was that came there in the night is not known to the people of the town. What the old man said is that the "
            "answer may be found in the book. Yes, nothing of this kind appears in it."),
        (2, "Was it the one who came in first? The boat was there, in the bay; is it what you want? The answer is no."),
    ]
    bench = spark.createDataFrame([
        (1, "kind"), (2, "Yes"), (3, "What is the answer?"), (4, "Who was the boat in?"), (5, "Is it in the one there?"), (6, "the answer is"),
    ], "item_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(-i, t) for i, t in prose], "doc_id long, text string"))
    assert decontaminate.find_leaks(docs, bench).count() == 0
    assert decontaminate.clean_documents(docs, bench).count() == docs.count()
    told = {r["item_id"]: r["test"] for r in decontaminate.item_tests(docs, bench).collect()}
    assert told[1] == told[2] == "none" and "subsequence" not in told.values()


def test_words_must_lie_close_together(spark, documents):
    item = "Seven wandering merchants carried silver lanterns across the frozen northern valley during winter"
    far = " ".join(w + " and then some other words came" for w in item.split())
    near = item.replace("wandering ", "old ").replace("northern ", "")
    whole = spark.createDataFrame([(-1, far), (-2, f"so {near} again"), (-3, " ".join(item.split()[:5]))], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(whole)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r["doc_id"], r["found"]) for r in decontaminate.find_leaks(docs, bench).collect()] == [(-2, "subsequence")]


def test_paraphrases_that_only_the_latent_way_finds(spark):
    """Copies in another order of words: no common subsequence, so the latent cosine decides; its recall is measured here."""
    import random

    items, texts = _planted(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(3000), 400)
    draw, shuffled = random.Random(7), []
    for (i, item), (_, text) in zip(items, texts, strict=True):
        words = item.split()
        draw.shuffle(words)
        shuffled.append((i, text.replace(item, " ".join(words))))
    docs, bench = spark.createDataFrame(shuffled, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["found"] for r in decontaminate.find_leaks(docs, bench).collect()}
    own = [found.get((i, i)) for i, _ in items]
    assert sum(f is not None for f in own) >= 0.9 * len(own) and own.count("latent") >= 0.85 * len(own)
    words = lambda text: set(re.findall(r"\w+", text.lower()))
    text_words, item_words = {i: words(t) for i, t in shuffled}, {i: words(t) for i, t in items}
    assert all(len(item_words[i] & text_words[d]) >= 0.65 * len(item_words[i]) for d, i in found)  # sources share passages


def test_split_words_by_unicode_class():
    import numpy as np
    import pyarrow as pa

    texts = ["Plain ASCII, no more", "«Ça» – l’été… naïve\u00a0façade", "昨天, ok 我 x", None, "ไทย abc ٣٤ \U0001f697x", "Ünï\u0301cödé"]
    want = ["plain ascii, no more", " ça    l été  naïve façade", " 昨天 , ok  我  x", "", " ไท ทย  abc ٣٤  x", "ünï\u0301cödé"]
    (first, end, data, offsets), = decontaminate.split_portions(pa.array(texts))
    got = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(end)]
    assert [g.split() for g in got] == [w.split() for w in want]
    assert isinstance(data, np.ndarray) and first == 0


def test_benchmarks_of_many_terms_stay_sparse(spark, documents):
    import tracemalloc

    items = [(i, " ".join(f"{'abcdefghij'[j % 10]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{chr(97 + j)}" for j in range(20))) for i in range(2500)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, "before this " + items[i][1] + " and after") for i in (0, 7, 2499)], "doc_id long, text string")
    tracemalloc.start()
    found = decontaminate.find_leaks(docs, bench)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(0, 0), (7, 7), (2499, 2499)}


def test_blocks_are_bounded_by_words(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    once = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    sizes, made = [], decontaminate.Benchmark.__init__
    monkeypatch.setattr(decontaminate.Benchmark, "__init__", lambda self, ids, words, *rest: (sizes.append(len(words)), made(self, ids, words, *rest))[1])
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 500)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()} == once
    assert len(sizes) > 1 and max(sizes) < 1000


def test_items_of_numbers_and_of_scripts_without_blanks(spark):
    items = [
        (1, "12 + 35 = 47, 47 + 81 = 128, 128 + 206 = 334"), (2, "哪个商人在午夜带着银灯笼穿过冰冻的山谷？"), (3, "the “silver” lantern… crossed the valley"),
        (4, "Room 101 costs 250 a night and room 202 costs 375 a night"),
    ]
    texts = [
        (1, "solve: 12 + 35 = 47, 47 + 81 = 128, 128 + 206 = 334 and so on"), (2, "有人问：昨天哪个商人在午夜带着银灯笼穿过冰冻的山谷，我不知道。"),
        (3, 'he said the "silver" lantern crossed the valley today'), (4, "here room 7 costs 18 a night and room 9 costs 44 a night"), (5, "solve: 13 + 36 = 49, 48 + 82 = 130"),
        (6, "昨天我们去商店买了一些水果和蔬菜"),
    ]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_items_without_an_id(spark):
    passages = ["Seven merchants carried silver lanterns across the frozen valley.", "Nobody in Granada remembers the old bridge over the river."]
    bench = spark.createDataFrame([(None, passages[0]), (3, passages[1]), (None, passages[1])], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + passages[0] + " " + passages[1]), (2, "other words alone"), (3, passages[0])], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()} == {(1, None), (1, 3), (3, None)}
    assert [r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()] == [2]


def test_items_in_several_blocks_are_reported_once(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 70)
    long = " ".join(f"word{i * i % 997}x" for i in range(400))
    bench = spark.createDataFrame([(5, long), (None, "Seven merchants carried silver lanterns across the frozen valley.")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + long), (2, "other words alone")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, 5)]


def _masked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["surrogate_text"] for r in surrogates.replace_entities(df).collect()}


def test_surrogates_keep_type_and_coreference(spark):
    out = _masked(spark, [
        "Mail Anna.Smith@Mail.example.com or anna.smith@mail.example.com now", "Call +1 (743) 555-3824 or +1-743-555-3824!",
        "Card 4539 1488 0343 6467 / 4539148803436467.", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" at 10.1.2.255.',
        "Anna Schmidt met Иван Петров; Mr Bean and Anna left.", None, "", "nothing here",
    ])
    a, b = re.findall(r"\S+@\S+", out[0])
    assert a.lower() == b and a != b and a.endswith(".com") and "smith" not in b and a[0].isupper()
    a, b = re.fullmatch(r"Call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1-\d{3}-\d{3}-\d{4})!", out[1]).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "17435553824"
    a, b = re.fullmatch(r"Card (\d{4} \d{4} \d{4} \d{4}) / (\d{16})\.", out[2]).groups()
    digits = [int(d) for d in reversed(b)]
    assert a.replace(" ", "") == b != "4539148803436467" and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r'token = "[0-9a-f]{40}" at (\d{1,3}\.){3}\d{1,3}\.', out[3]) and "24be" not in out[3]
    names = re.fullmatch(r"(\w+) (\w+) met (\w+) (\w+); Mr (\w+) and (\w+) left\.", out[4]).groups()
    assert names[0] == names[5] in surrogates.GIVEN["latin female"] and names[0] != "Anna"
    assert names[2] in surrogates.GIVEN["cyrillic male"] and re.fullmatch("[А-Я][а-я]+", names[3]) and names[1] != names[4]
    assert (out[5], out[6], out[7]) == (None, "", "nothing here")


def test_secrets_of_any_length_and_names_after_cues(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N"
    secrets = ["k7" * 150, "aGVsbG8gd29ybGQgaGVsbG8gd29ybGQ=", jwt, "sk-93ab55c2e41f9d08"]
    out = _masked(spark, [f'a = "{secrets[0]}"', f"b = '{secrets[1]}'", f"sent {jwt}, then", f"api_key={secrets[3]} and more", "a man named Robert Miller, and Dr. Quentin Farrow.", "the key: understanding others"])
    for i, secret in enumerate(secrets):
        assert secret not in out[i] and secret[4:12] not in out[i]
    assert re.fullmatch(r'a = "[0-9a-z]{300}"', out[0]) and re.fullmatch(r"b = '[0-9A-Za-z]{31}='", out[1])
    assert re.fullmatch(r"sent [\w-]+\.[\w-]+\.[\w-]+, then", out[2]) and len(out[2]) == len(f"sent {jwt}, then")
    assert re.fullmatch(r"api_key=[a-z]{2}-[0-9a-z]{16} and more", out[3])
    assert re.fullmatch(r"a man named (?!Robert)\w+ (?!Miller)\w+, and Dr\. (?!Quentin)\w+ (?!Farrow)\w+\.", out[4])
    assert out[5] == "the key: understanding others"


def test_surrogates_stay_distinct(spark):
    numbers = [f"{i}.0.0.{j}" for i in range(1, 60) for j in range(1, 60)]
    titled = ["Mr " + a + b for a in ("Stone", "Wood", "Brook") for b in "abcdefghij"]
    out = _masked(spark, [f"at {n} end" for n in numbers] + titled)
    made = [out[i][3:-4] for i in range(len(numbers))]
    assert len(set(made)) == len(numbers) and not set(made) & set(numbers)
    assert len({out[len(numbers) + i] for i in range(len(titled))}) == len(titled)


def test_numbers_of_further_kinds(spark):
    phones = ["743 555 3824", "07911 123456", "07911123456", "030 1234 5678", "12125550123"]
    addresses = ["2001:db8::ff00:42:8329", "2001:0DB8:0000:0000:0000:FF00:0042:8329", "fe80::1", "::1", "2001:db8:1::"]
    accounts = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB29NWBK60161331926819"]
    others = ["123-45-6789", f'"{"7" * 24}"']
    plain = ["at 12:30:45 on 2024-01-15", "std::vector and a::b", "pages 100 200 300", "1,234,567 of 250000000", "AB12 is a code", "mac aa:bb:cc:dd:ee:ff"]
    items = phones + addresses + accounts + others
    out = _masked(spark, [f"see {x} now" for x in items] + plain)
    made = [re.fullmatch("see (.*) now", out[i]).group(1) for i in range(len(items))]
    for old, new in zip(phones + accounts + others, made[:5] + made[10:]):
        assert re.sub("[A-Z]", "A", re.sub(r"\d", "0", new)) == re.sub("[A-Z]", "A", re.sub(r"\d", "0", old)) and new != old
    assert made[1].replace(" ", "") == made[2]
    expanded = [ipaddress.ip_address(x) for x in made[5:10]]
    assert expanded[0] == expanded[1] and made[6].isupper() and len(made[6]) == 39
    assert not set(expanded) & {ipaddress.ip_address(x) for x in addresses} and all("::" in x for x in made[7:10])
    assert made[10].replace(" ", "") == made[11] != accounts[1]
    for account in made[11:13]:
        assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1
    assert (made[11][:2], made[12][:2]) == ("DE", "GB")
    assert [out[len(items) + i] for i in range(len(plain))] == plain


def test_given_names_change_places_by_key(spark):
    names = surrogates.GIVEN["latin female"]
    seen = []
    for key in ("a", "b"):
        df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "doc_id long, text string")
        out = {r["doc_id"]: r["surrogate_text"] for r in surrogates.replace_entities(df, key=key).collect()}
        seen.append([names.index(out[i]) - i for i in range(len(names))])
        assert sorted(out.values()) == sorted(names) and 0 not in seen[-1]
    assert seen[0] != seen[1] and all(len({step % len(names) for step in steps}) > 3 for steps in seen)


def test_corpus_by_an_independent_detector(spark):
    """Entities planted among plain words: all go, all else stays, one surrogate for each, no two alike."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    makers = [
        lambda: f"{word()}.{word()}@{word()}.org", lambda: f"+44 20 {rng.randrange(1000, 9999)} {rng.randrange(1000, 9999)}",
        lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)), lambda: f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        lambda: ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8)), lambda: "4" + "".join(str(rng.randrange(10)) for _ in range(15)),
    ]
    pool = [make() for make in makers for _ in range(40)]
    texts, planted = [], []
    for _ in range(300):
        words = [word() for _ in range(rng.randint(5, 40))]
        places = sorted(rng.sample(range(len(words)), rng.randint(0, 4)))
        for place in places:
            words[place] = rng.choice(pool)
        texts.append("|".join(words).replace("|", " , "))
        planted.append([words[place] for place in places])
    texts.append("marked \x01 " + pool[0] + " \x01")
    planted.append([pool[0]])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = {}
    for row in surrogates.replace_entities(df).collect():
        old, new = texts[row["doc_id"]], row["surrogate_text"]
        assert row["entities"] == len(planted[row["doc_id"]])
        pattern = "(.+)".join(re.escape(part) for part in re.split("|".join(map(re.escape, planted[row["doc_id"]])) or "$^", old))
        found = re.fullmatch(pattern, new, re.S).groups()
        for entity, surrogate in zip(planted[row["doc_id"]], found):
            assert made.setdefault(entity, surrogate) == surrogate
    assert len(set(made.values())) == len(made) and not set(made.values()) & set(pool)


def test_surrogates_of_odd_rows(odd_documents, no_documents):
    out = surrogates.replace_entities(odd_documents, carry=tuple(odd_documents.columns))
    assert len(set(out.columns)) == len(out.columns)
    assert all(r["surrogate_text"] == r["text"] and r["entities"] == 0 for r in out.collect())
    assert surrogates.replace_entities(no_documents).count() == 0
