import random

from quernstone.llm import p5_quality as p5
from quernstone.llm import p6_scans as p6
from quernstone.llm import p7_packing as p7
from quernstone.llm import p8_leakage as p8
from quernstone.llm import p9_encoding as p9

PROSE = "The archive of the town holds more than the school, and no reader forgets how the map was made in that year. It was a quiet place."


def test_quality_rules(spark):
    cases = {
        "prose": PROSE, "list": "\n".join(f"- apple pear {i} stone" for i in range(9)), "references": "\n".join(f"[{i}] Smith, J.: A History of the Town. In: Miller (1999) 12-{i + 20}" for i in range(5)),
        "contents": "\n".join(f"The Map and the Town ....... {i}" for i in range(8)), "markup": "<td class=\"a\">1</td>\n.a { margin: 3px; }\nif (x > 1) { y[1]++; }", "numbers": "10 20 30 40 50 60 70 80 90 11 12", "empty": "", "long": PROSE * 800,
    }
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in cases.items()] + [("null", None, 1, "x"), ("prose", PROSE, 1, "x"), (None, PROSE, 1, "x")], "chunk_id string, contents string, stats int, failed string")
    got = {r.chunk_id: r.failed for r in p5.graded(df).collect()}
    assert {k for k, v in got.items() if not v} == {"prose", "long"} and "null" not in got
    assert "references" in got["references"] and "contents" in got["contents"] and "gopher_alphabetic" in got["numbers"] and "markup" in got["markup"] and got["empty"] == ["no_words"]
    assert p5.graded(df.limit(0)).count() == 0


def test_trie_retrieval_is_complete():
    r = random.Random(2)
    words = {"".join(r.choice("abcdel") for _ in range(r.randint(3, 7))): 10 for _ in range(300)}
    trie = p6.Trie(words)

    def close(a: str, b: str) -> bool:
        return a == b or any(b == e for i in range(len(a) + 1) for e in ([a[:i] + a[i + 1 :]] if i < len(a) else []) + [a[:i] + c + a[i + (k > 0) :] for c in "abcdel" for k in (0, 1)])

    for w in list(words)[:40]:
        query = w[:1] + "x" + w[2:]
        assert {b for b in words if close(query, b)} <= trie.within(query).keys()
    assert "modern" in p6.Trie({"modern": 5}).within("modem") and "method" in p6.Trie({"method": 5}).within("methocl")


def test_scans(spark):
    pages = [("c%d" % i, "d1", f"THE QUIET MAP {i}\n{PROSE}\nA sec-\nond line was left in the town for the readers of the time.", 1) for i in range(12)]
    pages += [("dirty", "d1", "The archlve".replace("l", "1") + " of the t0wn holds more than the schoo1, and no reader forgets how it was made.\n- 43 -", 1), ("null", "d1", None, 1), ("empty", "d1", "", 1), (None, "d1", "x", 1), ("nodoc", None, PROSE, 1)]
    df = spark.createDataFrame(pages + pages[:2], "chunk_id string, document_id string, contents string, kinds int")
    rows = {r.chunk_id: r for r in p6.mended(df).collect()}
    assert set(rows["c3"].kinds) == {"header", "page_number", "hyphenation"} and "second line" in rows["c3"].contents and "QUIET" not in rows["c3"].contents
    assert set(rows["dirty"].kinds) == {"character", "page_number"} and "the town holds" in rows["dirty"].contents and rows["dirty"].mended_words == 3
    assert not rows["nodoc"].kinds and not rows["empty"].kinds and "null" not in rows
    assert p6.mended(df.limit(0)).count() == 0


def fewest(sizes, capacity):
    def place(i, rooms):
        if i == len(sizes):
            return len(rooms)
        options = [place(i + 1, [*rooms, capacity - sizes[i]])]
        for j in {room: j for j, room in enumerate(rooms) if room >= sizes[i]}.values():
            options.append(place(i + 1, [room - sizes[i] if k == j else room for k, room in enumerate(rooms)]))
        return min(options)

    return place(0, [])


def test_packing(spark):
    r = random.Random(4)
    for _ in range(20):
        sizes = [r.randint(1, 100) for _ in range(40)]
        bins, _ = p7.bin_completion(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(40)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert p7.least_bins(sizes, 100) <= len(bins) <= len(p7.best_fit(sizes, 100))
    assert len(p7.bin_completion([6, 5, 5, 4, 4, 3, 3], 10)[0]) == 3
    for _ in range(60):  # without limits the packing is the least possible
        sizes = [r.randint(20, 70) for _ in range(r.randint(1, 9))]
        bins, proven = p7.bin_completion(sizes, 100, p7.UNLIMITED)
        assert proven and len(bins) == fewest(sizes, 100) and (len(p7.bin_completion(sizes, 100)[0]) == len(bins) or not p7.bin_completion(sizes, 100)[1])
    df = spark.createDataFrame([(1, 5000), (2, 100), (3, 0), (4, None), (None, 5), (2, 100), (5, 1948)], "doc_id long, tokens long")
    out = p7.pack(df).collect()
    assert sorted((x.doc_id, x.tokens) for x in out) == [(1, 904), (1, 2048), (1, 2048), (2, 100), (3, 0), (5, 1948)]
    fill = {}
    for x in out:
        fill[x.container] = fill.get(x.container, 0) + x.tokens
    assert max(fill.values()) <= 2048 and len(fill) == 4
    assert p7.pack(df.limit(0)).count() == 0
    texts = spark.createDataFrame([(1, "one two three"), (2, ""), (3, None)], "doc_id long, text string")
    assert {x.doc_id: x.tokens for x in p7.token_counts(texts).collect()} == {1: 3, 2: 0, 3: 0}


def test_leakage(spark):
    r = random.Random(6)
    vocabulary = [f"wörd{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(25))) for i in range(12)] + [(99, "a short one"), (98, None), (None, "x")]
    docs = []
    for d in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        if d % 3 == 0:
            item, n = items[d % 12][1].split(), r.randint(7, 14)
            at = r.randint(0, 25 - n)
            words[5:5] = [w.upper() if d % 2 else w.replace("ö", "ö") for w in item[at : at + n]]
        docs.append((d, " ".join(words) if d % 4 else ",\n".join(words).replace("wörd", "wö­rd"), 1))
    docs += [(100, None, 1), (101, "", 1), (None, items[0][1], 1), docs[0]]
    d_df, i_df = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, item_text string, doc_id int")

    def grams(t):
        w = p8.WORD.findall(p8.folded(t or ""))
        return {tuple(w[i : i + 10]) for i in range(len(w) - 9)}

    want = {(d, i) for d, t, _ in docs for i, x in items if d is not None and i is not None and grams(t) & grams(x)}
    got = {(x.doc_id, x.item_id) for x in p8.leaks(d_df, i_df).collect()}
    assert len(want) > 5 and got == want
    assert {(x.doc_id, x.item_id) for x in p8.leaks(d_df, i_df, broadcast_bytes=0).collect()} == want
    assert p8.leaks(d_df.limit(0), i_df).count() == 0 and p8.leaks(d_df, i_df.limit(0)).count() == 0


def test_encoding(spark):
    r = random.Random(8)
    words = {"fr": "le théâtre révèle déjà la règle où l'élève préfère être fidèle à côté".split(), "de": "der Schüler erhält für die Prüfung einen größeren Überblick später möglich".split(), "es": "el método todavía según la canción además razón señala aún época".split(), "en": "the map “quoted” was left — and no reader forgets how it is read".split()}
    docs = [(i * 10 + k, " ".join(r.choice(w) for _ in range(60)), lang) for k, (lang, w) in enumerate(words.items()) for i in range(60)]
    clean = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    models = p9.fit(clean)
    assert p9.garbled(clean, models).count() == 0
    original = {d: t for d, t, _ in docs}
    ways = {
        "utf8 as cp1252": lambda t: "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in t.encode()),
        "utf8 as latin-1": lambda t: t.encode().decode("latin-1"), "utf8 as mac": lambda t: t.encode().decode("mac_roman"), "twice": lambda t: t.encode().decode("latin-1").encode().decode("latin-1"), "cp1252 as cp850": lambda t: t.encode("cp1252").decode("cp850"),
    }
    for name, way in ways.items():
        bad = spark.createDataFrame([(d, way(t), None, 1) for d, t in list(original.items())[:60]], "doc_id long, text string, chain string, recovered int")
        rows = p9.garbled(bad, models).collect()
        touched = {d for d, t in list(original.items())[:60] if not t.isascii()}
        assert len({x.doc_id for x in rows} & touched) >= 0.95 * len(touched), name
        assert sum(x.text == original[x.doc_id] for x in rows) >= 0.9 * len(touched), name
    dirty = spark.createDataFrame([(1, None), (2, ""), (3, "Marks such as ©, ® and ¶"), (4, "Gr�fin und K�nig"), (5, "память and λόγος"), (None, "FÃ¼r")], "doc_id long, text string")
    assert [(x.doc_id, x.recovered) for x in p9.garbled(dirty, models).collect()] == [(4, False)]
    assert p9.garbled(dirty.limit(0), models).count() == 0


def test_scans_inside_a_page_break(spark):
    parts = [s + "." for s in PROSE.replace("?", ".").split(".") if s]
    above, below = ["the archive of the town holds", "more than the school, and no reader"], ["forgets how the map was made in", "that year, as it was left"]
    pages = [(f"c{i}", "d1", "\n".join([f"{parts[0]} {i}", *above, *furniture, *below, "for the readers of the time."]), 1) for i, furniture in enumerate((["THE QUIET MAP", "Page 35"], ["— 18 —", "The Quiet Map"], ["CHAPTER VII. After the Circuit, the Audience 49"]))]
    copy = "\n".join(["it was the year of the map and of the town,", "in which the school of the town was left", "Between Stone and the Archive", "there is more than the reader can see in it,", "and no map of the town is made for the school."])
    df = spark.createDataFrame([*pages, ("e1", "d1", copy, 1), ("e2", "d1", copy, 1)], "chunk_id string, document_id string, contents string, kinds int")
    rows = {r.chunk_id: r for r in p6.mended(df).collect()}
    for c in ("c0", "c1", "c2"):
        assert set(rows[c].kinds) == {"header", "page_number"} and "no reader forgets how" in rows[c].contents
    assert not rows["e1"].kinds and "left Between Stone" in rows["e1"].contents  # copies of a text are one text: its lines are not shared


def test_scans_with_a_hot_text(spark):
    damaged = "The archive of tliere is in the town and evcry reader of the le tter is at the school in that year."
    sound = [f"The map number {i} is in there for every reader of the letter, as it was made in that year." for i in range(12)]
    rows = [(f"s{i}", "d1", t, 1) for i, t in enumerate(sound)] + [(f"h{i}", "d2", damaged, 1) for i in range(6)] + [("h0", "d2", damaged, 1)] * 6
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, contents string, kinds int")
    counts = p6.vocabulary(df, least=1)
    assert counts["tliere"] == 1 and counts["there"] == 12
    got = {r.chunk_id: r for r in p6.mended(df).collect()}
    assert all(got[f"h{i}"].kinds == ["character"] and "of there is" in got[f"h{i}"].contents and "every reader of the letter" in got[f"h{i}"].contents for i in range(6))


def test_encoding_decoys_and_losses(spark):
    r = random.Random(9)
    en = "the map “quoted” was left — and no reader forgets how it is read in the town".split()
    fr = "le théâtre révèle déjà la règle où l'élève préfère être fidèle à côté dans la ville".split()
    docs = [(i, " ".join(r.choice(en if i % 2 else fr) for _ in range(50)), "en" if i % 2 else "fr") for i in range(120)]
    models = p9.fit(spark.createDataFrame(docs + docs[:9], "doc_id long, text string, lang string"))
    assert models == p9.fit(spark.createDataFrame(docs[::-1], "doc_id long, text string, lang string"))  # neither order nor copies matter
    cases = {
        1: "The sign «AMANHÃ» was left on the map of the town.", 2: "the town ◊†·◊▲‡ □◦‡§□◊~|▼_ ▲■††□~§", 3: "The library SÃO PAULO and NAÇÕES is in the town.", 4: "In the town the price is £40 and the word is λόγος.",
        5: "The map of the town â it was left â and the âquotedâ reader is in it.", 6: "the ôquotedö map ù and the ôquotedö reader ù is in the town", 7: "le th��tre r�v�le la r�gle dans la ville", 8: "&#226;&#8364;&#339;quoted&#226;&#8364;&#157; map in the town", 9: "if (x) &#1031; &#8851; &nbsp;",
    }
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in cases.items()], "doc_id long, text string, chain string, bits string")
    got = {x.doc_id: x for x in p9.garbled(df, models).collect()}
    assert set(got) == {5, 6, 7, 8}
    assert got[6].text == "the “quoted” map — and the “quoted” reader — is in the town" and got[6].recovered and got[8].text == "“quoted” map in the town"
    assert "théâtre révèle la règle" in got[7].text and not got[7].recovered and not got[5].recovered
    assert all(x.chain for x in got.values())  # nothing comes out without a chain that shortens it


def test_encoding_counts_whole_texts(spark):
    r = random.Random(10)
    de = "der Schüler erhält für die Prüfung einen größeren Überblick und das ist nicht später möglich".split()
    names = ["Brück" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(1500)]
    texts = [" ".join(["das ist nicht der", n, *(r.choice(de) for _ in range(12))]) for n in names]
    texts.append("Das ist die Bahn und der Turm.\n" * 800 + "Der Blütenstaub ist nicht für die Bahn.")  # the word stands after 24,000 characters
    texts += [f"the map is “archive” and the town {n[5:]} is in it" for n in names[:20]] + ["the âarchiveâ and the map is in the town"]
    lost = ["der Br�ckbd ist nicht für die Prüfung", "das ist der Bl�tenstaub und nicht der Überblick", "the �archive� and the map is in the town"]
    rows = [(i, t, [None, "ger", "de"][i % 3]) for i, t in enumerate([*texts, *lost])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = p9.fit(df)
    known = models.words["de"]
    assert all(known.get(n.replace("ü", "�")) == n for n in [*names, "Blütenstaub"])  # no text, end of a text or tag leaves a word out
    assert "�archive�" not in models.words["en"]  # a word that is itself damaged proves nothing
    assert models == p9.fit(df.select("text"))
    own, whole = ({(x.doc_id, x.chain, x.recovered, x.text) for x in p9.garbled(*of).collect()} for of in ((df,), (df, models)))
    assert own == whole  # the words asked for do what all words do
    got = {d: t for d, _, _, t in own}
    assert [got[len(texts) + i].split()[k] for i, k in ((0, 1), (1, 3))] == ["Brückbd", "Blütenstaub"] and got[len(texts) + 2] == lost[2]


def test_scans_with_few_words_at_hand(spark):
    r = random.Random(11)
    rare = ["lantern", "harbour", "quarry", "meadow", "thistle", "granary", "foundry", "orchard"]
    sound = [f"The {a} and the {b} of the town were in the map for every reader of the letter, as it was {c} there." for a, b, c in ((r.choice(rare), r.choice(rare), r.choice(["made", "read", "kept"])) for _ in range(80))]
    bad = ["The lantem was in the town for every reader as it was made.", "The harb0ur and the mead ow were in the map of the town.", "The thistIe is at the orch-\nard and the q1arry of the town.", "The granaiy was in the town, and evcry reader knew that it was there."]
    rows = [(f"s{i}", "d1", t, 1) for i, t in enumerate(sound)] + [(f"b{i}", "d2", t, 1) for i, t in enumerate(bad)]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, contents string, kinds int")
    whole = {x.chunk_id: x for x in p6.mended(df).collect()}
    assert len(p6.vocabulary(df)) > 20 and "lantern" in whole["b0"].contents and "meadow" in whole["b1"].contents and "orchard" in whole["b2"].contents
    for most in (5, 12, 21):
        assert {x.chunk_id: x for x in p6.mended(df, most=most).collect()} == whole
