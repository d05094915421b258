"""The subpackage's operators against brute force, public libraries and awkward rows."""

import base64
import os
import random
from itertools import accumulate

import numpy as np
import pytest

from veilspark.functions.shingles import word_hashes
from veilspark.llm import langid, leakage, mixing, personal, residue, tokens

VOCABULARY = tokens.VOCABULARY
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")

EN = ["the service desk asked the supplier to send the signed receipts again because the list was old", "two teams tested whether the new export accepts urgent price lists until the system is available again", "the night crew checked the open test reports against the list and the difference was explained"]
DE = ["die Abteilung bat die Firma um fehlende Belege und wartete zwei Wochen auf eine Antwort der Leitung", "das Projektbüro schrieb eine kurze Zusammenfassung für die Abteilung und legte sie im Archiv ab", "nach der Besprechung wurde der Antrag mit zwei Anmerkungen angenommen und in das nächste Quartal verschoben"]
NL = ["het projectbureau schreef een korte samenvatting voor de afdeling terwijl de ploeg op een antwoord wachtte", "de leverancier heeft de bonnetjes opnieuw gestuurd omdat het dossier nog niet was nagekeken", "na het overleg werd de aanvraag met twee opmerkingen aangenomen en naar het volgende kwartaal verplaatst"]
FR = ["le bureau de projet a rédigé un bref résumé pour le service pendant que l'équipe attendait une réponse", "après la réunion la demande a été acceptée avec deux remarques et reportée au trimestre suivant", "les copies de factures ont été rangées dans la salle par la formatrice et le contrôle suivra"]
ES = ["la oficina del proyecto redactó un breve resumen para el departamento mientras el equipo esperaba una respuesta", "después de la reunión la solicitud fue aceptada con dos observaciones y aplazada al próximo trimestre", "el archivo guardó los documentos en la sala y la próxima revisión será en el mes de enero"]


def test_residue_and_reports(spark):
    filler = [(f"f{i}", f"Item {i} was stored in room {i} and the list of the team was checked again on page {i}.", "gen_a") for i in range(60)]
    cases = [
        ("r1", "Dear {{employee_name}},\nplease sign.", " Gen_A"), ("r2", "Lorem  ipsum\ndolor sit amet", "gen_b"), ("r3", "<p>404 - the page https://a.test/x could not be found</p>", "gen_b"),
        ("r4", "PLEASE ENABLE JAVASCRIPT TO CONTINUE TO PrestBase.", None), ("r5", "Total: [Your Company Name]", "gen_b"), ("r6", "Site: XXXXXXXX", "gen_b"), ("r7", "text text text text text", "gen_b"), ("r8", "Please return it to YYYY-MM-DD by noon.", "gen_b"), ("r9", "word " * 40_000 + "\nSample text goes here.", "gen_b"),
    ]
    fine = [
        ("o1", 'The merge field "{{customer_no}}" is filled by BomSync since version 5.4.16, as the trainer reported.', "gen_b"), ("o2", "A 404 page for Vaprur was designed by Wakav AG and costs 8896.59 EUR.", "gen_b"), ("o3", "<div>General Note</div> [scan page 216]", "gen_b"),
        ("o4", "The pattern YYYY-MM-DD is used for all backup tapes in GovVault, said the trainer.", "gen_b"), ("o5", "Access denied messages in GovVault fell by 95% after the shift lead cleaned the groups.", "gen_b"), ("o6", "Mail: tobias(at)host.example or x {at} host.example", "gen_b"), ("o7", None, "gen_b"), ("o8", "", None), ("o9", " \n ", None),
    ]
    df = spark.createDataFrame([(*r, 1) for r in [*filler, *cases, *fine, cases[0], (None, "Lorem ipsum dolor sit amet", "gen_b")]], "rid string, body string, gen string, kind int")
    found = {r["id"]: r for r in residue.residue(df, "rid", "body").where("kind is not null").collect()}
    assert set(found) == {r[0] for r in cases}
    report = {r["gen"]: r for r in residue.residue_report(df, "rid", "body", "gen").collect()}
    assert report["gen_a"]["excluded"] == 1 and report["gen_a"]["records"] == 61
    kept = residue.exclude_residue(df, "rid", "body")
    assert kept.count() == len(filler) + len(fine) + 1 and kept.columns == df.columns
    assert residue.residue(df.limit(0), "rid", "body").count() == 0


def test_residue_beside_a_report_counts(spark):
    pattern, field = "The pattern YYYY-MM-DD applies to all backup tapes in GovVault according to the trainer.", 'The merge field "{{customer_no}}" is filled by BomSync since version 5.4.16, as the trainer reported.'
    filler = [(f"f{i}", f"Item {i} was stored in room {i} and the list of the team was checked again on page {i}.") for i in range(60)]
    cases = [("c1", f"Kundennummer: {{{{customer_id}}}}. {pattern}"), ("c2", f"Kundennummer: {{{{customer_id}}}}. {field}"), ("c3", f"{field} Name: {{{{employee_name}}}}"), ("c4", f"{pattern} Date: YYYY-MM-DD"), ("c5", f"Date: YYYY-MM-DD {pattern}"), ("c6", "The pattern YYYY-MM-DD applies to all {{tapes}} in GovVault according to the trainer.")]
    fine = [("o1", pattern), ("o2", field), ("o3", f"{pattern} {field} {pattern}"), ("o4", f"Number: 12. {field}")]
    df = spark.createDataFrame([*filler, *cases, *fine], "rid string, body string")
    assert {r["id"] for r in residue.residue(df, "rid", "body").where("kind is not null").collect()} == {r[0] for r in cases}


@needs_vocabulary
def test_token_counts_equal_the_library():
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=table, special_tokens={})
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab'sStreld ve'll\n\t é 世²1３Ⅷ.,!’-_😀́\x1c\x85") for _ in range(rnd.randint(0, 50))) for _ in range(1500)] + [None, "", " ", "a's", "'stone", "\n's", "!'s", "x" * 5000, *EN, *DE]
    assert tokens.Counter(VOCABULARY).count(texts).tolist() == [len(known.encode_ordinary(t)) if t else 0 for t in texts]


@needs_vocabulary
def test_token_budget_rolls_up(spark):
    rows = [("a", "one two three", " EN", "x"), ("a", "one two three", "en", "x"), ("b", None, None, "x"), (None, "zwei Worte", "de", "y"), (None, "zwei Worte", "de", "y"), ("c", "", "en", None)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc string, body string, language string, source string, tokens int")
    got = tokens.token_budget(df.drop("tokens"), "doc", "body", ["source", "language"]).collect()
    one = {r["doc"]: r["tokens"] for r in tokens.token_counts(df.drop("tokens"), "body", ["doc"]).collect()}
    total = next(r for r in got if r["level"] == 2)
    nameless = sum(r["tokens"] for r in tokens.token_counts(df.drop("tokens"), "body", ["doc"]).collect() if r["doc"] is None)
    assert total["documents"] == 5 and total["tokens"] == one["a"] + one["b"] + one["c"] + nameless and nameless > 0
    assert sum(r["tokens"] for r in got if r["level"] == 0) == total["tokens"] == sum(r["tokens"] for r in got if r["level"] == 1)


@needs_vocabulary
def test_token_budget_has_every_subtotal(spark):
    rows = [("a", "one two three", "en", "x", "mail"), ("b", "zwei Worte", "de", "x", "note"), ("c", "four", "en", "y", "mail"), ("d", "vier", None, "y", "note"), ("e", "five six", "en", "y", None)]
    df = spark.createDataFrame(rows, "doc string, body string, language string, source string, kind string")
    by = ["source", "language", "kind"]
    one = {r["doc"]: r["tokens"] for r in tokens.token_counts(df, "body", ["doc"]).collect()}
    want = {}
    for doc, _, language, source, kind in rows:
        for bits in range(8):
            key = (bits, *(None if bits >> (2 - k) & 1 else v for k, v in enumerate((source, language, kind))))
            n, t = want.get(key, (0, 0))
            want[key] = n + 1, t + one[doc]
    got = tokens.token_budget(df, "doc", "body", by, every=True).collect()
    assert {(r["grouping"], *(r[c] for c in by)): (r["documents"], r["tokens"]) for r in got} == want and len(got) == len(want)
    assert all(r["level"] == r["grouping"].bit_count() for r in got)


@needs_vocabulary
def test_mix_meets_shares_and_caps(spark):
    rows = [(i, "alpha beta gamma delta " * 5, ["big", " BIG ", "Small", None, "rest"][i % 5 if i % 50 else 2] if i % 7 else "big") for i in range(2000)] + [(5000, None, "small"), (5001, "", "small")]
    df = spark.createDataFrame(rows, "doc long, body string, source string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 1), ("absent", 0.1, 3), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(df, targets, "doc", "body", "source")
    lines, got = {r["source"]: r for r in report.collect()}, mixed.collect()
    assert set(lines) == {"big", "small", "absent"} and lines["absent"]["short"] and lines["absent"]["tokens"] == 0
    assert max(r["copies"] for r in got) <= 2 and len({r["id"] for r in got}) == len(got)
    assert abs(lines["big"]["tokens"] - lines["big"]["needed_tokens"]) < 0.1 * lines["big"]["needed_tokens"]
    assert sorted(r["id"] for r in mixing.mix(df, targets, "doc", "body", "source")[0].collect()) == sorted(r["id"] for r in got)
    assert mixing.emitted(df, mixed, "doc").count() == sum(r["copies"] for r in got)
    assert mixing.mix(df.limit(0), targets, "doc", "body", "source")[1].where("short").count() == 0


PEOPLE = [
    ("Please route this to Ms Orson Pralevow in Plant Safety.", {("PERSON", "Orson Pralevow")}),
    ("Kopie an: Keiwernmann, Thea; Einkauf\nOrt: Havhaven", {("PERSON", "Keiwernmann, Thea")}),
    ("handled by T. Setrumström-Nedalkmann / 12:30", {("PERSON", "T. Setrumström-Nedalkmann")}),
    ("Contact: petra faufarnström (petra77 [at] vereil [dot] co [dot] example)", {("PERSON", "petra faufarnström"), ("EMAIL_ADDRESS", "petra77 [at] vereil [dot] co [dot] example")}),
    ("RENÉE TROREXSEN - nostley_k at morax dot invalid", {("PERSON", "RENÉE TROREXSEN"), ("EMAIL_ADDRESS", "nostley_k at morax dot invalid")}),
    ("Bitte nach Urban von Brifenström fragen, +49 (0)171 39200-78.", {("PERSON", "Urban von Brifenström"), ("PHONE_NUMBER", "+49 (0)171 39200-78")}),
    ("Tel: 0012025550154 ext. 866\nBatch: 0559166942\nDatum: 03-01-2025", {("PHONE_NUMBER", "0012025550154 ext. 866")}),
    ("Call (415) 555-0187 or 415.555.0165x400 between 10:00 and 11:00.", {("PHONE_NUMBER", "(415) 555-0187"), ("PHONE_NUMBER", "415.555.0165x400")}),
    ("Tax ID 57 888 770 324\nInsurance no. QQ 28 48 66 C was entered. Device serial: C926FL9G4", {("ID_NUMBER", "57 888 770 324"), ("ID_NUMBER", "QQ 28 48 66 C")}),
    ("Der Personalausweis L23GF40120 lag vor. Die Besucherausweise REF-1234567 auch.", {("ID_NUMBER", "L23GF40120")}),
    ("Anschrift: Mewellstraße 91c, 41381 Delbrück\nPick-up point is 50 Sasel Rd., Bexmouth.", {("STREET_ADDRESS", "Mewellstraße 91c"), ("STREET_ADDRESS", "50 Sasel Rd.")}),
    ("For project KALK, Herav AG delivered 3 lists on https://a.test/b/12345 from 203.0.113.4.", set()),
    (None, set()), ("", set()), ("   ", set()),
]


def test_personal_items_in_many_spellings():
    for text, want in PEOPLE:
        assert {(k, text[i:j]) for i, j, k in personal.find(text)} == want, text


def test_placeholders_and_surrogates(spark):
    texts = [t for t, _ in PEOPLE] + ["Contact: Tobias Kolalksen <tobias.kolalksen@a.example>", "re: Kolalksen, Tobias, sick leave. KOLALKSEN, TOBIAS was there", "re: T. Kolalksen, sick leave", "wort " * 30_000 + "Contact: Tobias Kolalksen"]
    df = spark.createDataFrame([(f"d{i}", t, 1) for i, t in enumerate(texts)] + [("d0", texts[0], 2), (None, texts[0], 3)], "doc string, body string, items int")
    marked = {r["id"]: r for r in personal.placeholders(df, "doc", "body").collect()}
    assert marked["d0"]["text"] == "Please route this to Ms [PERSON] in Plant Safety." and marked["d12"]["text"] is None and marked["d13"]["text"] == ""
    found = personal.items(df, "doc", "body")
    table = {(r["type"], r["text"]): r["surrogate"] for r in personal.surrogate_table(found, "key").collect()}
    assert set(table) == {(r["type"], r["text"]) for r in personal.distinct_items(found).collect()}
    same = {}
    for (kind, text), new in table.items():
        assert new != text and personal._same(new) not in {personal._same(t) for _, t in table}
        same.setdefault((kind, personal._same(new)), set()).add(personal._same(text))
    assert all(len(v) == 1 for v in same.values())
    first, last = table["PERSON", "Tobias Kolalksen"].split()
    assert table["PERSON", "Kolalksen, Tobias"] == f"{last}, {first}" and table["PERSON", "KOLALKSEN, TOBIAS"] == f"{last}, {first}".upper()
    assert table["PERSON", "T. Kolalksen"] == f"{first[0]}. {last}" and table["EMAIL_ADDRESS", "tobias.kolalksen@a.example"].startswith(f"{first}.{last}@".lower())
    assert table["PHONE_NUMBER", "+49 (0)171 39200-78"].startswith("+49 (0)") and table["STREET_ADDRESS", "Mewellstraße 91c"].endswith("c")
    new = {r["id"]: r["text"] for r in personal.surrogates(df, "doc", "body", "key").collect()}
    assert new["d0"] == f"Please route this to Ms {table['PERSON', 'Orson Pralevow']} in Plant Safety." and "Kolalksen" not in new["d18"]
    assert personal.surrogates(df.limit(0), "doc", "body", "key").count() == 0


def test_surrogates_keep_every_row(spark):
    name = "Please route this to Ms Orson Pralevow in Plant Safety."
    df = spark.createDataFrame([("a", name), (None, name), ("b", None), ("c", ""), ("d", " \n "), (None, None), ("a", name)], "doc string, body string")
    got = [tuple(r) for r in personal.surrogates(df, "doc", "body", "key").collect()]
    new = dict(got)["a"]
    assert "Pralevow" not in new and sorted(got, key=str) == sorted([("a", new), (None, new), ("b", None), ("c", ""), ("d", " \n "), (None, None), ("a", new)], key=str)


def test_leaks_against_brute_force(spark):
    rnd = random.Random(7)
    words = [f"word{i}" for i in range(300)]
    items = [(100 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(70, 120)))) for i in range(12)]
    docs = []
    for i in range(150):
        w = [rnd.choice(words) for _ in range(rnd.randint(0, 150))]
        if i % 3 == 0:
            t = items[i % 12][1].split()
            n = rnd.choice([18, 23, 24, 25, 31, 60])
            at = rnd.randint(0, len(t) - min(n, len(t)))
            k = rnd.randint(0, len(w))
            w[k:k] = t[at : at + n]
        docs.append((i, ("\t" if i % 2 else " , ").join(w).upper()))
    docs += [(900, None), (901, ""), (902, "short"), (0, docs[0][1]), (903, "x " * 20_000 + items[3][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc long, body string, item_id int")
    held = spark.createDataFrame([*items, (999, None), (998, "few words"), items[0]], "item long, passage string")
    got = {(r["id"], r["item_id"]) for r in leakage.leaks(df, held, "doc", "body", "item", "passage").where("longest_run >= 24").collect()}
    import re

    def runs(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[k : k + 24]) for k in range(len(w) - 23)}

    grams = {i: runs(t) for i, t in items}
    want = {(d, i) for d, t in docs for mine in [runs(t)] for i, theirs in grams.items() if mine & theirs}
    assert want and got == want
    report = {r["item_id"]: r["documents"] for r in leakage.item_report(leakage.leaks(df, held, "doc", "body", "item", "passage"), held, "item").collect()}
    assert sum(report.values()) == len(want) and report[999] == 0
    assert leakage.leaks(df.limit(0), held, "doc", "body", "item", "passage").count() == 0 == leakage.leaks(df, held.limit(0), "doc", "body", "item", "passage").count()


def test_candidates_have_every_pair_of_the_cosine():
    rnd, rng = random.Random(3), np.random.default_rng(3)
    words = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(80))) for i in range(20)]
    docs = [" ".join(rnd.choice(words) if rnd.random() < 0.08 else w for w in items[i % 20][1].split()[i % 8 :]) for i in range(200)] + ["", "word1 " * 40]
    size = 1 << leakage.FEATURE_BITS
    idf, basis = rng.uniform(1, 5, size).astype(np.float32), rng.standard_normal((size, leakage.RANK)).astype(np.float32)
    index = leakage.Index(items, idf, basis)
    hashes, at = word_hashes(docs)
    window = np.arange(leakage.WINDOW)
    first = np.concatenate([np.arange(a, b - leakage.WINDOW + 1, leakage.STRIDE) for a, b in zip(at[:-1], at[1:])])

    def vectors(h, starts):
        v = (basis * idf[:, None])[leakage._features(h)][starts[:, None] + window].sum(1)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    near = vectors(hashes, first) @ vectors(index.words, index.starts).T
    want = set()
    for p, q in zip(*np.nonzero(near >= 0.9001)):
        mine = index.words[index.starts[q] + window]
        if np.isin(mine[np.argsort(-idf[leakage._features(mine)], kind="stable")[:3]], hashes[first[p] + window]).sum() >= leakage.ANSWER:
            want.add((int(first[p]), int(q)))
    a, b, cosine = index.candidates(hashes, at, 0.9)
    got = list(zip(a.tolist(), b.tolist()))
    assert len(want) > 200 and want <= set(got) and len(set(got)) == len(got) and (cosine >= 0.9).all()


def test_every_candidate_of_an_item_is_compared(spark):
    items = [(i, " ".join("the" if k == 12 else f"item{i}x{k}" for k in range(24))) for i in range(6)]
    filler = " ".join(f"the {i}a" for i in range(24))
    docs = [(i, filler) for i in range(20)]
    for i, text in items:
        w = text.split()
        reworded = " ".join([*w[:12], "a", *w[13:]])
        docs += [(100 + i, f"{' '.join(w[15::-1])} {filler} {reworded}"), (200 + i, f"{' '.join(w[15::-1])} {filler}"), (300 + i, f"a {reworded}")]
        docs += [(400 + i, f"{filler} {' '.join([*w[:18], 'a', 'a', *w[20:]])}")]
    df, held = spark.createDataFrame(docs, "doc long, body string"), spark.createDataFrame(items, "item long, passage string")
    got = {(r["id"], r["item_id"]): (r["longest_run"], round(r["subsequence_share"], 6)) for r in leakage.leaks(df, held, "doc", "body", "item", "passage").collect()}
    assert got == {(d + i, i): (run, round(n / 24, 6)) for i in range(6) for d, run, n in ((100, 0, 23), (300, 0, 23), (400, 18, 22))}


def test_a_single_passage_is_found_in_every_block(spark, monkeypatch):
    items = [(i, " ".join(f"item{i}x{k}" for k in range(16))) for i in range(3)]
    filler = " ".join(f"the {i}a" for i in range(24))
    df = spark.createDataFrame([(i, filler) for i in range(20)] + [(100 + i, f"{filler} {text} {filler}") for i, text in items], "doc long, body string")
    held = spark.createDataFrame(items, "item long, passage string")
    want = {(100 + i, i, 16, 1.0) for i in range(3)}
    for block in (leakage.BLOCK, 1):
        monkeypatch.setattr(leakage, "BLOCK", block)
        assert {tuple(r) for r in leakage.leaks(df, held, "doc", "body", "item", "passage").collect()} == want
    assert {tuple(r) for r in leakage.leaks(df, held.where("item = 1"), "doc", "body", "item", "passage").collect()} == {(101, 1, 16, 1.0)}


def test_common_subsequences_equal_the_table():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 6, 300).astype(np.uint64), rng.integers(0, 6, 300).astype(np.uint64)
    lo, lo2 = rng.integers(0, 290, 80), rng.integers(0, 290, 80)
    hi, hi2 = np.minimum(lo + rng.integers(1, 33, 80), 300), np.minimum(lo2 + rng.integers(1, 49, 80), 300)

    def table(x, y):
        row = [0] * (len(y) + 1)
        for u in x:
            row = [0, *accumulate((max(row[k + 1], row[k] + (u == v)) for k, v in enumerate(y)), max)]
        return row[-1]

    assert leakage.common_subsequences(a, lo, hi, b, lo2, hi2).tolist() == [table(a[i:j].tolist(), b[k:n].tolist()) for i, j, k, n in zip(lo, hi, lo2, hi2)]


def test_languages_of_segments(spark):
    rnd = random.Random(1)
    groups = {"en": EN, "de": DE, "nl": NL, "fr": FR, "es": ES}
    rows = [(f"{code}{i}", ". ".join(rnd.sample(group, 3)) + ".", f" {code.upper()}_X" if i % 2 else code) for code, group in groups.items() for i in range(12)]
    rows += [("mix", f"{EN[0]}. {EN[1]}.\n\n{DE[0]}. {FR[1]}.", "en"), ("none", f"{NL[0]}. {NL[1]}.", None), ("wrong", f"{ES[0]}. {ES[2]}.", "fr"), ("greet", f"{EN[0]}. {EN[2]}.\n\nMit freundlichen Grüßen\n", "en-GB"), ("null", None, "en"), ("empty", "", "xx"), ("short", "ja nein", "de"), ("long", (f"{DE[1]}. " * 3000), "de"), ("wrong", f"{ES[0]}. {ES[2]}.", "fr")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc string, body string, label string, segments int")
    weights = langid.train(df, "doc", "body", "label")
    found = langid.segments(df, "doc", "body", weights)
    got = {(r["id"], r["lang"]) for r in langid.wrong_or_mixed(df, found, "doc", "label").collect()}
    assert got == {("mix", "en"), ("mix", "de"), ("mix", "fr"), ("none", "nl"), ("wrong", "es")}
    by = {r["id"]: r["segments"] for r in found.collect()}
    assert [s["lang"] for s in by["mix"]] == ["en", "de", "fr"] and [s["start"] for s in by["mix"]][0] == 0 and all(0 <= s["confidence"] <= 1 for v in by.values() for s in v)
    assert by["short"][0]["longest"] == 0 and len(by["long"]) == 1 and "null" not in by
    assert langid.document_languages(found).where("id = 'mix'").count() == 3
    assert langid.segments(df.limit(0), "doc", "body", weights).count() == 0
    assert langid.train(df.limit(0), "doc", "body", "label").any() == False  # noqa: E712


def test_samples_hold_at_any_number_of_rows(spark, monkeypatch):
    # The share of the key space for a table of n rows, drawn from keys as such a table has them near zero.
    monkeypatch.setattr(langid, "TRAIN_DOCS", 40)
    for n in (10**9, 10**11):
        keys = [(i / n, "en", f"text {i}") for i in range(1000) for _ in range(2)]
        rows = spark.createDataFrame(keys, "key double, label string, text string")
        assert langid.labelled_sample(rows, {"en": n}).count() == 100
    assert langid.labelled_sample(rows.limit(0), {}).count() == 0
    texts = spark.range(40_000).selectExpr("concat('text ', if(id < 13000, 0, id)) as text")
    monkeypatch.setattr(leakage, "FIT_DOCS", 2_000)
    assert 1_000 < leakage.fit_sample(texts, 40_000).count() < 2_000
    assert leakage.fit_sample(texts, 10**13).count() == 0 or leakage.fit_sample(texts, 10**13).count() < 3


def test_filler_in_any_order_is_covered_by_passages(spark):
    filler = [(f"f{i}", f"Item {i} was stored in room {i} and the list of the team was checked again on page {i}.") for i in range(40)]
    cases = [("c1", "Veniam commodo cillum laboris ipsum aliqua nisi sit voluptate labore."), ("c2", "Room 4: asdf jklö asdf jklö asdf"), ("c3", "nisi commodo aliqua nisi dolor")]
    fine = [("o1", "The et al. citation in dolor was kept."), ("o2", "asdf jklö"), ("o3", "the ex officio member and the ad hoc team in the quorum")]
    df = spark.createDataFrame([*filler, *cases, *fine], "rid string, body string")
    assert {r["id"] for r in residue.residue(df, "rid", "body").where("kind is not null").collect()} == {r[0] for r in cases}


def test_first_names_are_learned_from_the_corpus(spark):
    rnd = random.Random(2)
    firsts = ["Kwame", "Aiko", "Priya", "Thandiwe", "Bogdan", "Ximena", "Oluwaseun", "Siobhan", "Rajesh", "Yevgenia"]
    lasts = ["Okafor", "Tanaka", "Ramanathan", "Dlamini", "Petrescu", "Quispe", "Adeyemi", "Gallagher", "Iyer", "Sokolova", "Mbeki", "Saito"]
    assert not {f.lower() for f in firsts} & set(personal._FIRST)
    told = ["Contact: {}, room 4.", "Please ask Ms {} for the list.", "{1} Q. {2} signed.", "{} <{3}@mail.example>"]
    plain = ["The list was sent by {} on Monday.", "{} agreed on the plan.", "Two copies went to {} and to the archive."]

    def line(form, first, last):
        name = f"{first} {last}"
        return form.replace("{1}", first).replace("{2}", last).replace("{3}", f"{first}.{last}".lower()).replace("{}", name)

    rows = [(line(rnd.choice(told), f, rnd.choice(lasts)),) for f in firsts for _ in range(8)]
    cases = [(line(form, f, last), f"{f} {last}") for f in firsts for last in lasts for form in plain]
    filler = [(f"Contact: Data Platform. The Data Platform team and Field Sales met in Room {i}.",) for i in range(40)]
    df = spark.createDataFrame([*rows, *[(t,) for t, _ in cases], *filler, (None,), ("",)], "body string")
    learned = personal._learned(personal.learn(df, "body"))
    found = sum(name in {t[i:j] for i, j, k in personal.find(t, learned) if k == "PERSON"} for t, name in cases)
    assert found >= 0.9 * len(cases)
    assert not sum(name in {t[i:j] for i, j, k in personal.find(t) if k == "PERSON"} for t, name in cases)
    assert personal.find("The Data Platform team and Field Sales met.", learned) == []


def test_names_are_found_at_all_their_places():
    text = "Contact: Priya Ramanathan, call me. Regards, PRIYA RAMANATHAN. priya ramanathan-x and Priya Ramanathans"
    assert [text[i:j] for i, j, _ in personal.find(text)] == ["Priya Ramanathan", "PRIYA RAMANATHAN"]
    for text, want in (("at 12 Rue de la Paix, 75002 Paris", "12 Rue de la Paix"), ("en Calle Mayor 5, Madrid", "Calle Mayor 5"), ("SSN 123-45-6789", "123-45-6789")):
        assert [text[i:j] for i, j, _ in personal.find(text)] == [want]


def test_surrogates_keep_scripts_and_area_codes():
    draw = personal.Surrogates(b"key")
    made = {draw.of("PERSON", w, n) for w in ("王伟", "王芳", "李") for n in range(5)}
    assert all("一" <= c <= "龥" for w in made for c in w) and len(made) > 10
    assert all(c == " " or "а" <= c.lower() <= "я" for c in draw.of("PERSON", "Анна Иванова"))
    assert all(draw.of("PHONE_NUMBER", "+1 (415) 555-0187", n)[4] in "23456789" for n in range(20))
