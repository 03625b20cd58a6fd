import random

import numpy as np
import pytest

from ledgerloom.llm import langid

SENTENCES = {
    "en": ["The board reviewed the agreement and approved it without changes.", "We expect that lower volumes will reduce our result for the year.", "The debts to our lenders were paid on the last day of the period."],
    "de": ["Der Aufsichtsrat hat die Vereinbarung geprüft und ihr zugestimmt.", "Wir rechnen damit, dass neue Auflagen das Ergebnis belasten werden.", "Die Verbindlichkeiten wurden zum Stichtag vollständig bezahlt."],
    "fr": ["Le conseil a examiné cet accord et il a été approuvé sans changement.", "Nous pensons que la hausse des salaires pourrait réduire notre résultat.", "Les dettes envers nos banques ont été payées à la fin de la période."],
    "es": ["El consejo revisó el acuerdo y lo aprobó sin cambios importantes.", "La dirección considera que la demanda podría reducir el resultado.", "Las deudas con nuestros bancos se pagaron en la fecha de cierre."],
    "it": ["Il consiglio ha esaminato l'accordo e lo ha approvato senza modifiche.", "La direzione ritiene che la domanda potrebbe ridurre il risultato.", "I debiti verso le nostre banche sono stati pagati alla chiusura."],
    "pt": ["O conselho analisou o acordo e aprovou o texto sem alterações.", "A direção considera que a procura poderá reduzir o nosso resultado.", "As dívidas para com os nossos bancos foram pagas na data de fecho."],
    "nl": ["Het bestuur heeft de overeenkomst beoordeeld en goedgekeurd.", "Wij verwachten dat hogere lonen het resultaat zullen verlagen.", "De schulden aan onze banken werden op de balansdatum betaald."],
    "sv": ["Styrelsen har granskat avtalet och godkänt det utan ändringar.", "Ledningen bedömer att brist på delar kan minska resultatet för året.", "Skulderna till våra banker betalades på balansdagen enligt plan."],
    "pl": ["Zarząd zapoznał się z umową i zatwierdził ją bez żadnych zmian.", "Spodziewamy się, że niższy popyt może zmniejszyć wynik spółki.", "Zobowiązania wobec naszych banków zostały spłacone na dzień bilansowy."],
    "ja": ["取締役会は契約を検討し、これを変更なしで承認しました。", "経営陣は、需要の低下により業績が減少する可能性があると考えています。", "銀行に対する債務は期末日に全額支払われました。"],
}


def passage(lang, rng, n=200):
    out = ""
    while len(out) < n:
        out += rng.choice(SENTENCES[lang]) + ("" if lang == "ja" else " ")
    return out.strip()


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    sample = []
    for k in range(400):
        lang = langid.LANGUAGES[k % 10]
        label = langid.LANGUAGES[(k + 3) % 10] if k % 9 == 0 else lang  # wrong labels are in the sample
        sample.append((passage(lang, rng, 120), label))
    return langid.fit(sample, langid.read_pieces())


def test_held_out_words(model):
    """Sentences that the sample doesn't hold."""
    unseen = {
        "en": "Several customers have asked for longer terms, and this may affect their orders.", "de": "Mehrere Kunden haben um längere Fristen gebeten, und das könnte ihre Aufträge beeinflussen.",
        "fr": "Plusieurs clients ont demandé des délais plus longs, ce qui peut toucher leurs commandes.", "es": "Varios clientes han pedido plazos más largos, lo que puede afectar a sus pedidos.",
        "it": "Diversi clienti hanno chiesto termini più lunghi, che possono influire sugli ordini della società.", "nl": "Enkele klanten hebben om langere termijnen gevraagd, en dat kan van invloed zijn op hun bestellingen.",
        "sv": "Flera kunder har bett om längre frister, och det kan påverka deras beställningar.", "ja": "複数の顧客がより長い期間を求めており、注文に影響する可能性があります。",
    }
    words = [langid.cut_words(t) for t in unseen.values()]
    got = [langid.LANGUAGES[k] for k in model.unit_scores(words).argmax(axis=1)]
    assert sum(a == b for a, b in zip(got, unseen)) >= 7


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "▁ab", "a", "b", "ab"]
    p = np.full((8, 10), 0.0)
    p[:6] = np.array([0.1, 0.2, 0.05, 0.3, 0.25, 0.1])[:, None]
    m = langid.Model(pieces, p)
    got = m.forward(m.lattice(["ab"]))[0, -1, 0]
    assert got == pytest.approx(0.05 + 0.2 * 0.25 + 0.1 * 0.1 + 0.1 * 0.3 * 0.25)


def test_mixed_documents(model):
    rng = random.Random(2)
    right = total = 0
    for k in range(60):
        a, b = rng.sample(langid.LANGUAGES, 2)
        text = passage(a, rng, 220) + "\n\n" + passage(b, rng, 220)
        if k % 2:
            text = text.upper()
        chars = {}
        for _, _, n, lang, c in langid.stretches(model, [text])[0]:
            chars[langid.LANGUAGES[lang]] = chars.get(langid.LANGUAGES[lang], 0) + n
            assert 0 < c <= 1
        total += 1
        right += {x for x, n in chars.items() if n >= 150} == {a, b}
    assert right >= 0.9 * total


def test_figures_are_no_running_text(model):
    table = "\n".join(f"Goodwill\t$ {n},916\t{n}.4%" for n in range(100, 160)) + "\n" + "\n".join(["Net sales", "30,399", "Term debt"] * 30)
    assert langid.stretches(model, [table, None, "", " \n "]) == [[], [], [], []]


@pytest.mark.parametrize(
    ("label", "lang"),
    [("en_GB", "en"), ("ENG", "en"), ("English", "en"), ("pt-PT", "pt"), ("deu", "de"), (" French ", "fr"), ("ja-JP", "ja"), ("Español", "es"), ("und", None), ("-", None), ("n/a", None), ("xx", None), ("", None), (None, None), ("unknown", None)],
)
def test_labels(label, lang):
    assert langid.label_language(label) == lang


def test_documents(spark):
    rng = random.Random(3)
    rows = [(k, passage(langid.LANGUAGES[k % 10], rng, 300), langid.LANGUAGES[k % 10]) for k in range(200)]
    rows += [
        (1000, passage("de", rng, 300), "en"), (1001, passage("fr", rng, 300), None), (1002, passage("en", rng, 300) + "\n\n" + passage("pl", rng, 300), "en"), (1003, passage("sv", rng, 300), "sv-SE"), (1004, None, "en"),
        (1005, "", None), (1006, "short one.", None), (1007, passage("it", rng, 300), "n/a"), (1007, passage("it", rng, 300), "n/a"), (1008, passage("nl", rng, 100_000), "xx"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, n_langs int")
    found = langid.mislabelled(langid.document_languages(df))
    assert {(r.doc_id, r.lang) for r in found.collect()} == {(1000, "de"), (1001, "fr"), (1002, "en"), (1002, "pl"), (1007, "it"), (1008, "nl")}
    segments = [r for r in langid.segments(df).collect() if r.doc_id == 1002]
    assert [r.lang for r in segments] == ["en", "pl"] and all(0.9 < r.confidence <= 1 for r in segments)
    assert langid.mislabelled(langid.document_languages(df.limit(0))).collect() == []
