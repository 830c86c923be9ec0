"""Cut-off, scanned, leaked and garbled texts."""

import random

import numpy as np
import pytest

from citeflow.llm import encodings, leaks, scanned, truncation

SENTENCES = ["The trial enrolled older men at nine sites.", "Adverse events led some participants to stop early.", "We found modest evidence that the drug lowered blood pressure.", "Risk of bias was marked because the estimate was not concealed.", "Follow-up at two years showed that the score had returned to its baseline.", "Certainty was rated low because few reports met the threshold."]


class TestTruncation:
    def texts(self):
        rng = random.Random(1)
        out, cut = [], set()
        for i in range(900):
            t = " ".join(rng.choice(SENTENCES) for _ in range(rng.randrange(3, 12)))
            source = "a" if i % 2 else "b"
            if source == "a" and len(t) > 400:
                t = t[:400].rstrip()
                if not t.endswith("."):
                    cut.add(i)
            elif i % 9 == 0:
                t += " Keywords: drug; pressure; score"
            out.append((i, source, t))
        return out, cut

    def test_finds_cuts_and_limits(self, spark):
        rows, cut = self.texts()
        extra = [(2000, "a", None), (2001, "b", ""), (2002, None, "A whole sentence ends here."), (1, "a", rows[1][2]), (2003, "b", "## Abstract\n\n## Introduction\nx"), (2004, "b", "x" * 40000 + ". End.")]
        df = spark.createDataFrame(rows + extra, "k long, source string, text string")
        got = truncation.detect(df, "k", "source", "text").collect()
        found = {r.k for r in got if r.truncated}
        assert len(cut) > 100 and len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 2
        assert {r.k for r in got} == {i for i, _, _ in rows} | {2002, 2004}

    def test_nothing(self, spark):
        assert truncation.detect(spark.createDataFrame([], "k long, source string, text string"), "k", "source", "text").count() == 0

    def test_a_colon_alone_makes_no_label(self, spark):
        rng, rows, cut, labelled = random.Random(3), [], set(), set()
        for i in range(900):
            t = " ".join(rng.choice([*SENTENCES, "Certainty was rated low: many reports of older carers met no threshold at all."]) for _ in range(rng.randrange(3, 12)))
            if i % 2 and len(t) > 400:
                t = t[:400].rstrip()
                if not t.endswith("."):
                    cut.add(i)
                    if "low: " in t.rsplit(". ", 1)[-1]:
                        labelled.add(i)
            elif i % 9 == 0:
                t += " Keywords: drug; pressure; score"
            elif i == 2:
                t += " Registration: ABC 17"  # a rare label is one all the same
            rows.append((i, "ab"[i % 2], t))
        got = truncation.detect(spark.createDataFrame(rows, "k long, source string, text string"), "k", "source", "text")
        found = {r.k for r in got.where("truncated").collect()}
        assert len(labelled) > 10 and labelled <= found and 2 not in found and len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 2

    def test_abbreviations_and_entities_are_judged_by_counts(self, spark):
        rng, rows = random.Random(8), []
        more = ["Drug vs. placebo was compared in trial no. 3 there.", "They asked for more and the answer was no. All of them left.", "The trial was run in Sacramento, CA. Older men were asked."]
        for i in range(600):
            t = " ".join(rng.choice([*SENTENCES, *more]) for _ in range(rng.randrange(3, 9)))
            if i % 12 == 0:
                t = t[: 120 + i // 3]
            rows.append((i, "ab"[i % 2], t))
        ends = {1000: "the answer was no.", 1001: "It was run in Sacramento, CA.", 1002: "They spent it on industrial R&D.", 1003: "compared the drug vs.", 1004: "returned to its base&ly", 1005: "the drug lowered [truncated]", 1006: "the drug lowered <sup"}
        rows += [(k, "a", " ".join(SENTENCES[:3]) + " " + t) for k, t in ends.items()]
        got = {r.k: r for r in truncation.detect(spark.createDataFrame(rows, "k long, source string, text string"), "k", "source", "text").collect()}
        assert {k for k in ends if got[k].truncated} == {1003, 1004, 1005, 1006}
        assert [got[k].form for k in (1004, 1005, 1006)] == ["open", "mark", "part"]
        assert not truncation._part("industrial R&D") and not truncation._part("was p <0.001") and not truncation._part("(P <0.05)") and truncation._part("caf&eacu")

    def test_limits_beyond_any_length_are_found(self, spark):
        rng, rows = random.Random(9), []
        for i in range(60):
            t = " ".join(rng.choice(SENTENCES) for _ in range(4000 if i % 2 else rng.randrange(3000, 3600)))
            rows.append((i, "a", t[:150000].rstrip() if i % 2 else t))
        got = {r.k: r for r in truncation.detect(spark.createDataFrame(rows, "k long, source string, text string"), "k", "source", "text").collect()}
        cut = {i for i, _, t in rows if i % 2 and not t.endswith(".")}
        assert len(cut) > 20 and {k for k, r in got.items() if r.truncated} == cut and all(got[k].prior > 0.5 for k in cut if got[k].length == 150000)

    def test_fit_recovers_a_limit(self):
        rng = np.random.default_rng(0)
        x = np.exp(rng.normal(6, 0.5, 4000)).astype(int)
        at = (x > 500) & (rng.random(4000) < 0.5)
        n = np.where(at, 500, x)
        lengths, where = np.unique(n, return_inverse=True)
        fit = truncation.fit_lengths(lengths.astype(float), np.bincount(where).astype(float), np.bincount(where, weights=at).astype(float))
        assert [limit for limit, _ in fit["limits"]] == [500.0]
        assert abs(fit["mu"] - 6) < 0.12 and truncation.censored(500, fit) > 0.8 > truncation.censored(300, fit)


class TestScanned:
    def known(self):
        words = {w: 500 for w in "the trial enrolled older pregnant women at nine sites between and score returned to its baseline interval dose limiting long term signal stayed modern burden quality".split()}
        return words, dict.fromkeys(["dose limiting", "long term", "pregnant women", "older pregnant", "the trial", "its baseline"], 9)

    @pytest.mark.parametrize("token,want", [("preqnant", "pregnant"), ("intcrval", "interval"), ("bascline", "baseline"), ("burclen", "burden"), ("qiiality", "quality"), ("rnodern", "modern"), ("s1tes", "sites"), ("duv0emia", "duvoemia"), ("spandaixaban", None), ("KORIX", None), ("women", None)])
    def test_misread(self, token, want):
        r = scanned.Repairer(*self.known())
        assert r.read(token, "older", "women") == want

    NAMED = {"hcspital": "hospital", "hospitol": "hospital", "trestment": "treatment", "treatnent": "treatment", "respouse": "response"}

    def plain_edits(self):
        words = {w: 300 for w in ("hospital", "treatment", "response", "the", "was", "given", "clear", "of")}
        pairs = {f"{a} {b}": 40 for w in ("hospital", "treatment", "response") for a, b in (("the", w), (w, "was"))}
        return words, pairs

    def test_plain_edits_win_where_the_context_confirms(self, monkeypatch):
        r = scanned.Repairer(*self.plain_edits())
        for bad, good in self.NAMED.items():
            assert r.read(bad, "the", "was") == good and r.read(bad, "given", "clear") is None
        for rare in ("hospitel", "rexponze", "treadment"):  # words of their own stay: they are in several texts
            r.words[rare] = 30
            assert r.read(rare, "the", "was") is None
        honest = scanned.Trie.within
        monkeypatch.setattr(scanned.Trie, "within", lambda self, token, distance, plain=True: honest(self, token, distance, False))
        assert not any(r.read(bad, "the", "was") for bad in self.NAMED)

    def test_tries_of_beginnings_and_ends_hold_all_candidates(self):
        rng, letters = random.Random(5), "abcdeimnru"
        words = {"".join(rng.choice(letters) for _ in range(rng.randrange(2, 12))): 9 for _ in range(400)}
        whole, parts = scanned.Trie(words), {}
        for w in words:
            for key in scanned.shelves(w):
                parts.setdefault(key, {})[w] = 9
        parts = {key: scanned.Trie(held) for key, held in parts.items()}
        for w in list(words)[:150]:
            i, c = rng.randrange(len(w)), rng.choice(letters)
            t = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w.replace("m", "rn", 1).replace("d", "cl", 1)])
            if not scanned.examined(t):
                continue
            want, got = set(), set()
            for key, form, edits, faint, plain in scanned.searches(t):
                want |= set(scanned.looked_up(whole, t, form, edits, faint, plain))
                got |= set(scanned.looked_up(parts[key], t, form, edits, faint, plain)) if key in parts else set()
            assert got == want, (w, t)

    def test_the_cluster_repairs_as_one_trie_does(self, spark):
        rng, good = random.Random(7), ["The hospital gave the treatment and the response was clear.", "In the hospital the treatment was given to older women.", "The response was weak while the treatment went on."]
        rows = [(i, " ".join(rng.choice(good) for _ in range(3))) for i in range(40)] + [(100, "In the hcspital the trestment was given and the respouse was weak."), (101, "Older worncn in the hospital."), (102, "A hospitel band played.")]
        df = spark.createDataFrame(rows, "k long, text string")
        got = {r.k: (r.kinds, r.repaired) for r in scanned.repaired(df, "k", "text", scanned.lexicon(df)).collect()}
        assert got[100] == (["glyph"], "In the hospital the treatment was given and the response was weak.")
        assert got[101] == (["glyph"], "Older women in the hospital.") and got[102] == ([], "A hospitel band played.")
        more = df.unionAll(df.where("k < 100").selectExpr("explode(sequence(1, 9)) AS i", "k", "text").selectExpr("k + 1000 * i", "text"))  # ten times as many texts
        again = {r.k: (r.kinds, r.repaired) for r in scanned.repaired(more, "k", "text", scanned.lexicon(more)).where("k between 100 and 102").collect()}
        assert again == {k: got[k] for k in again} and len(again) == 3

    def test_automaton_is_complete(self):
        rng = random.Random(3)
        words = sorted({"".join(rng.choice("abcdeim") for _ in range(rng.randrange(2, 7))) for _ in range(150)})
        trie = scanned.Trie(dict.fromkeys(words, 1))

        def distance(a, b):
            p = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                q = [i]
                for j, y in enumerate(b, 1):
                    q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
                p = q
            return p[-1]

        for _ in range(60):
            t = "".join(rng.choice("abcdeim") for _ in range(rng.randrange(1, 7)))
            for k in (1, 2):
                assert set(trie.within(t, k)) >= {w for w in words if distance(t, w) <= k}

    def test_repairs_a_page(self):
        text = "Annals of Trials\nThe trial enrolled older preg-\nnant women at nine sites and the score\nreturned to its\nAnnals of Trials\n- 12 -\n\x0cbaseline at the long-\nterm signal of the trial and the\ndose stayed at nine sites and the score\nAnnals of Trials\n- 13 -\nreturned to its bascline."
        kinds, out = scanned.Repairer(*self.known()).repair(text)
        assert kinds == ["hyphen", "glyph", "header", "page"]
        assert out == "The trial enrolled older pregnant women at nine sites and the score returned to its baseline at the long-term signal of the trial and the dose stayed at nine sites and the score returned to its baseline."

    def test_line_breaks_alone_are_clean(self):
        assert scanned.Repairer(*self.known()).repair("Methods\n\nThe trial enrolled older\npregnant women at nine\nsites.\n\nMethods\n\nThe score returned.") == ([], "Methods\n\nThe trial enrolled older pregnant women at nine sites.\n\nMethods\n\nThe score returned.")

    def test_rows(self, spark):
        rows = [(1, '{"abstract": "The trial en-\\nrolled women", "extraction_status": "ok"}'), (1, '{"abstract": "The trial en-\\nrolled women", "extraction_status": "ok"}'), (2, None), (3, ""), (None, "x"), (4, "{broken"), (5, "word " * 20000), (6, "\n\n"), (7, "12")]
        df = spark.createDataFrame(rows, "k long, text string")
        got = {r.k: (r.kinds, r.repaired) for r in scanned.repaired(df, "k", "text", scanned.lexicon(df)).collect()}
        assert got[1] == (["hyphen"], "The trial enrolled women") and got[4][0] == [] and got[6] == ([], "") and set(got) == {1, 4, 5, 6, 7}
        assert scanned.repaired(df.limit(0), "k", "text", scanned.lexicon(df.limit(0))).count() == 0


class TestLeaks:
    def items(self):
        rng = random.Random(5)
        skeleton = "which study from {} let its margin put {} ahead of {} for bone density when {} of {} older men carried {} and the {} archive was sparse".split(" ")
        word = lambda: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(4))
        return [(i, " ".join(word() if w == "{}" else w for w in skeleton * 2)) for i in range(30)]

    def test_whole_part_altered_and_decoys(self, spark):
        rng, items = random.Random(6), self.items()
        filler = lambda n: " ".join("filler%d" % rng.randrange(900) for _ in range(n))
        docs, want = [], set()
        for i, t in items:
            w = t.split()
            altered = [x if rng.random() > 0.1 else "changed" for x in w]
            docs.append((10 * i, f"{filler(30)} {t.upper()}. {filler(20)}"))
            docs.append((10 * i + 1, filler(30) + "\n> " + "\n> ".join(" ".join(w[k : k + 5]) for k in range(4, 30, 5))))
            docs.append((10 * i + 2, f"{filler(9)} {' '.join(altered)}"))
            docs.append((10 * i + 3, f"As noted, {' '.join(w[3:9])}, and so on. {filler(9)}"))
            want |= {(10 * i + k, i) for k in (0, 1, 2)}
        extra = [(None, docs[0][1]), (5000, None), (5001, ""), (5002, filler(30000)), (5003, "  \n")]
        got = leaks.matches(spark.createDataFrame(docs + docs[:1] + extra, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, ""), (97, "too short")], "item_id long, text string"))
        found = {(r.doc_id, r.item_id) for r in got.where("leaked").collect()}
        assert found == want
        assert leaks.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), got).count() == len(items)

    def test_nothing(self, spark):
        docs, items = spark.createDataFrame([(1, "x y z")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
        assert leaks.matches(docs, items).count() == 0 and leaks.matches(docs.limit(0), items).count() == 0

    def test_verbatim_run_of_common_words(self, spark):
        rng, common = random.Random(4), [f"common{i}" for i in range(40)]
        items = [(i, " ".join(rng.sample(common, 40))) for i in range(20)]
        w = items[3][1].split()
        docs = [(1, f"As noted, {' '.join(w[5:20])}, and so on."), (2, f"As noted, {' '.join(w[5:19])}, and so on.")]
        got = leaks.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert {(r.doc_id, r.item_id, r.longest) for r in got.where("leaked").collect()} == {(1, 3, 15)}

    def test_short_items_places_and_blocks(self, spark, monkeypatch):
        items = [*self.items(), (50, "ten words that only this one short test item has"), (51, "few words")]
        w = items[2][1].split()
        docs = [(1, "we saw ten words that only this one short test item has today"), (2, "few words and ten words that only one"), (3, f"a b {' '.join(w[6:30])} c"), (4, " ".join(x if i % 9 else "changed" for i, x in enumerate(w)))]
        d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = {tuple(r) for r in leaks.matches(d, t).where("leaked").collect()}
        assert {(r[0], r[1]) for r in got} == {(1, 50), (3, 2), (4, 2)}
        assert {r[2:5] for r in got if r[0] in (1, 3)} == {(10, 2, 0), (24, 2, 6)}
        monkeypatch.setattr(leaks, "BLOCK_BYTES", 700)  # blocks of the test texts change nothing
        monkeypatch.setattr(leaks, "PLACES", 3)
        assert {tuple(r) for r in leaks.matches(d, t).where("leaked").collect()} == got

    def test_suffix_array_and_search_against_brute_force(self):
        rng = random.Random(1)
        texts = [(i, " ".join(rng.choice("abcdef") for _ in range(12))) for i in range(5)]
        tests = leaks.Tests(texts)
        seq = np.array([rng.randrange(0, 7) for _ in range(400)] + [0] * leaks.DEPTH, dtype=np.int32)
        order = leaks.suffix_array(seq)
        live = [p for p in range(400) if all(seq[p : p + leaks.SEED])]

        def key(p):
            end = p
            while seq[end] and end - p < leaks.DEPTH:
                end += 1
            return list(seq[p:end])

        assert sorted(order.tolist()) == live
        assert all(key(a) <= key(b) for a, b in zip(order, order[1:]))
        query, longest, low, high = leaks.search(seq, order, tests)

        def match(p, q):
            n = 0
            while seq[p + n] and seq[p + n] == tests.flat[q + n]:
                n += 1
            return n

        best = {q: max((match(p, q) for p in live), default=0) for q in range(len(tests.flat) - leaks.DEPTH)}
        assert dict(zip(query.tolist(), longest.tolist())) == {q: n for q, n in best.items() if n >= leaks.SEED}
        for q, lo, hi in zip(query, low, high):
            head = tests.flat[q : q + leaks.SEED].tolist()
            assert sorted(order[lo:hi].tolist()) == [p for p in live if seq[p : p + leaks.SEED].tolist() == head]

    def test_alignment_is_a_longest_common_subsequence(self):
        rng = random.Random(2)
        for _ in range(100):
            a, b = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 12))], [rng.randrange(1, 5) for _ in range(rng.randrange(1, 12))]
            kept, place = leaks.aligned(b, a)
            d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a)):
                for j in range(len(b)):
                    d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
            at = [int(p) for p in place if p >= 0]
            assert kept.sum() == d[-1][-1] and at == sorted(set(at)) and all(a[i] == b[p] for i, p in enumerate(place) if p >= 0)


class TestEncodings:
    CLEAN = ["Les données recueillies étaient incomplètes à l’hôpital.", "Die Prüfärzte bewerteten die Qualität als mäßig.", "La administración redujo la presión en “España”.", "As conclusões são frágeis; NÃO HÁ evidência.", "尚不清楚是否适用于老年人和孕妇。", "Итог раунда: дозы", "The café’s naïve 5 µg ≥ 3 €"]

    def repairer(self):
        samples = {str(i): [f"{t} {n}" for n in range(60)] for i, t in enumerate(self.CLEAN)}
        return encodings.Repairer(*encodings.fit(samples))

    @pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251"])
    def test_exact_round_trip(self, wrong):
        r = self.repairer()
        back = {v: k for k, v in encodings._TABLES[wrong].items()}
        for t in self.CLEAN[:4] + self.CLEAN[6:]:
            bad = "".join(chr(b) if b < 128 else chr(back.get(b, b)) for b in t.encode())
            assert bad != t and r.repair(bad)[0] == t, (wrong, t)

    def test_twice_and_in_part(self):
        r, t = self.repairer(), self.CLEAN[0]
        twice = t.encode().decode("latin-1").encode().decode("latin-1")
        assert r.repair(twice)[0] == t
        part = self.CLEAN[1] + " " + t.encode().decode("latin-1")
        assert r.repair(part)[0] == self.CLEAN[1] + " " + t
        assert r.repair("尚不清楚是否适用".encode().decode("gb18030"))[0] == "尚不清楚是否适用"

    @pytest.mark.parametrize("right,wrong", [("koi8_r", "cp1251"), ("cp1251", "latin-1"), ("cp1251", "cp1252"), ("cp866", "cp1251"), ("cp850", "cp1252")])
    def test_one_byte_text_read_in_another_encoding_of_one_byte(self, right, wrong):
        r = self.repairer()
        t = "Итог раунда дозы, Итог дозы раунда" if right != "cp850" else "Die Prüfärzte bewerteten die Qualität als mäßig für Prüfärzte."
        back = {v: k for k, v in encodings._TABLES[wrong].items()}
        bad = "".join(chr(b) if b < 128 else chr(back.get(b, b)) for b in t.encode(right))
        assert bad != t and r.repair(bad)[0] == t

    @pytest.mark.parametrize("right", ["gb18030", "big5"])
    def test_two_byte_text_read_as_latin(self, right):
        r, t = self.repairer(), "尚不清楚是否人和" if right == "gb18030" else "不清楚是否人和"
        assert r.repair(t.encode(right).decode("latin-1"))[0] == t

    def test_a_chain_whose_first_step_saves_nothing(self):
        r, t = self.repairer(), self.CLEAN[0]
        steps = {}
        honest = r.gain
        r.gain = lambda a, b, parts: steps.setdefault((a, b), -1 if not steps else honest(a, b, parts))
        assert r.repair(t.encode().decode("latin-1").encode().decode("latin-1"))[0] == t

    def test_clean_texts_stay(self):
        r = self.repairer()
        for t in [*self.CLEAN, "", "plain", "👩‍🔬 🧪", "ملخص סיכום", "á vs á; ﬁ vs fi; ﾃｽﾄ", "S&atilde;o \\u00e9"]:
            assert r.repair(t) == (t, "", 0)

    def test_rows(self, spark):
        bad = self.CLEAN[0].encode().decode("latin-1")
        rows = [(i, "fr", f"{self.CLEAN[0]} {i}") for i in range(50)] + [(100, "fr", bad), (None, "fr", bad), (101, None, "Sch�tzung f�r"), (102, "fr", None), (103, "fr", ""), (104, "FR", "é" * 50000)]
        docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
        got = {r.doc_id: (r.repaired, r.lost) for r in encodings.find(docs, "doc_id", "text", encodings.dictionaries(docs)).collect()}
        assert got == {100: (self.CLEAN[0], False), 101: (None, True)}
        empty = docs.limit(0)
        assert encodings.find(empty, "doc_id", "text", encodings.dictionaries(empty)).count() == 0

    def test_scripts_outside_the_sample_are_known(self, spark):
        rare = "ملخص النتائج غير واضح للمرضى"
        rows = [(i, "fr", f"{self.CLEAN[0]} {i}") for i in range(50)] + [(100, None, f"{rare} بعد"), (101, "fr", "Résumé : " + rare.encode().decode("latin-1")), (102, "fr", f"{self.CLEAN[0]} " * 200 + "תקציר")]
        docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
        fitted = encodings.dictionaries(docs)
        assert {"ARABIC", "HEBREW"} <= fitted[2]
        assert {r.doc_id: r.repaired for r in encodings.find(docs, "doc_id", "text", fitted).collect()} == {101: "Résumé : " + rare}

    def test_dictionaries_hold_what_all_rows_say(self, spark):
        """No language, long text or document beyond a number is left out."""
        rows = [(i, f"l{i % 30}", f"word{i % 30} shared" + " tail" * (2000 if i % 30 == 7 else 1)) for i in range(120)]
        rows += [(1000 + i, "many", f"common start {i}") for i in range(900)] + [(2000 + i, "many", "rareword twice") for i in range(2)]
        by, _, _ = encodings.dictionaries(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
        assert set(by) == {f"l{i}" for i in range(30)} | {"many"}
        assert all(f" word{i} shared".encode() in by[f"l{i}"] for i in range(30))
        assert b" rareword twice" in by["many"] and b" common start" in by["many"]
