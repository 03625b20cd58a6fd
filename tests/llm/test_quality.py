import pytest

from ledgerloom.llm import quality

PROSE = (
    "We received notice on June 19, 2024 that headcount no longer meets the listing rule. The board appointed a new auditor after our "
    "lenders completed a review, and we may reprice the backlog. Our leased warehouses served 2,497 customers in the second quarter."
)
LIST = "\n".join(f"{n}.{n + 1} certificate of Rosnix {n}" for n in range(1, 20))
TABLE = "\n".join(f"Net sales\t{n * 731:,}\t{n}.4%\t({n * 17:,})" for n in range(1, 20))
COLUMN = "\n".join(["30,399", "183,175", "Net income", "—", "618,059", "(771,154)", "Gross profit"] * 6)
LEADERS = "\n".join(f"Drevlo Net sales {'.' * 40} {n}" for n in range(20, 30))
MARKUP = "\n".join(f"<td id=a{n}>{n * 913:,}</td><!-- 31fbfe -->" for n in range(20))
MENU = "\n".join(["Sitemap · Governance · Alerts · Norvaka", "Home · Search · Back to top", "Careers · Download · Investors"] * 4)


@pytest.mark.parametrize("text", [LIST, TABLE, COLUMN, LEADERS, MARKUP, MENU, "Qz9/x+aB" * 60])
def test_not_prose(text):
    solid, _, _, prose = quality.shares(text)
    assert prose < 0.2 * solid


@pytest.mark.parametrize(
    "text",
    [
        PROSE,
        PROSE.upper(),
        PROSE.replace(" ", "\n"),
        "\n".join(PROSE[i : i + 60] for i in range(0, len(PROSE), 60)),
        "Die Verbindlichkeiten betrugen zum Stichtag 314,4 Mio. EUR. Der Vorstand rechnet damit, dass neue Auflagen das Ergebnis belasten.",
        "取締役会は契約を検討し、これを承認しました。鉄道車両事業の利益率は低下しました。",
        "• Interest cost improved 36.1% following the amendment of the indenture.\n• The ledger was closed late because of the shortage of resin.",
    ],
)
def test_prose(text):
    solid, _, _, prose = quality.shares(text)
    assert prose > 0.7 * solid


def test_mixed_by_share():
    solid, _, _, prose = quality.shares(TABLE + "\n\n" + PROSE)
    assert 0 < prose < solid


def test_findings_and_odd_rows(spark):
    rows = [
        ("a", 3, LIST, "x"), ("a", 3, LIST, "x"), ("b", len(PROSE), PROSE, None), ("c", 5, None, "x"), ("d", 0, "", "x"), ("e", None, " \n ", "x"), ("f", 1, "é" + chr(0x1F600), "x"),
        (None, 1, "lost key", "x"), ("g", None, TABLE * 200, "x"), ("h", 200, " " * 200, "x"),
    ]
    df = spark.createDataFrame(rows, "section_id string, char_len int, text string, finding string")
    got = sorted(map(tuple, quality.findings(df).collect()))
    assert got == [("a", "char_len"), ("a", "not_prose"), ("f", "char_len"), ("g", "not_prose")]
    stats = {r.section_id: r for r in quality.statistics(df).collect()}
    assert stats["c"].n_chars is None and stats["d"].n_words == 0 and stats["d"].mean_word is None
    assert stats["b"].prose_share == 1.0 and stats["g"].table_share > 0.9 and stats["b"].n_words == len(quality._WORD.findall(PROSE))
    assert quality.findings(df.limit(0)).collect() == [] and quality.statistics(df.limit(0)).collect() == []


def test_line_figures():
    assert quality.autocorrelation([5, 5, 5, 5]) == 1.0 and quality.autocorrelation([1, 9, 1, 9, 1, 9], 1) < 0 < quality.autocorrelation([1, 9, 1, 9, 1, 9])
    assert quality.alignment(["a|b|c", "d|e|f"]) == 1.0 and quality.alignment(["plain", "words"]) == 0.0


OUTLINE = ["District offices and depots of the group", "harbour works together with cold stores", "Regional laboratories and their fittings", "kilns and furnaces for road materials"]


def test_columns_alone_decide():
    cells = [("Northern district warehouses", "harbour works"), ("Southern foundry", "cold stores and depots"), ("Inland laboratories", "wafer lines"), ("Coastal terminals and quays", "grain elevators")]
    aligned, ragged = [f"{a:<34}{b}" for a, b in cells], [f"{a} {b}" for a, b in cells]
    assert quality.column_alignment(aligned) == 1.0 and quality.column_alignment(ragged) == 0.0
    assert quality.block_kind(aligned) == "table" and quality.block_kind(ragged) == "text"
    right = [f"{a:<30}{n:>12,}" for a, n in (("Net sales of all of the segments", 4), ("Gross profit", 93111), ("Selling expense", 77), ("Term debt", 1200300))]
    assert quality.block_kind(right) == "table"


def test_indents_alone_decide():
    nested = [("    " if n % 2 else "") + x for n, x in enumerate(OUTLINE * 2)]
    assert quality.periodicity(nested)[1] == 1.0 and quality.block_kind(nested) == "list"
    assert quality.periodicity(OUTLINE * 2) == (0.0, 0.0) and quality.block_kind(OUTLINE * 2) == "text"
    assert quality.block_kind([x + "." for x in nested]) == "text"  # the ends of sentences forbid it
    assert quality.block_kind(["    " + x for x in OUTLINE * 2]) == "text"  # one indent for all says nothing


def test_line_lengths_alone_decide():
    long, short = "the offices and depots of the northern district group with laboratories", "the harbour works and cold stores"
    alternating, mixed = [long, short] * 4, [long, long, short, long, short, short, short, long]
    assert quality.autocorrelation([len(x) for x in alternating]) > 0.5 > quality.autocorrelation([len(x) for x in mixed])
    assert quality.block_kind(alternating) == "list" and quality.block_kind(mixed) == "text"
    assert quality.autocorrelation([5, 5]) == 0.0 and quality.autocorrelation([5, 5, 5]) == 1.0


def test_sentences_are_not_joined_with_what_stands_above_them():
    said = "We had 5,213 employees in our pet nutrition operations, of whom 2,917 worked at the northern site."
    for above in ("v/6O+d1HkK0rdepKDWvYNiyc7rhGVeJKnr6cZ65iLtzHemVl4bhZtiTEB38+2UoSD", "dei0:TaxRateLummoka 2012-06-01 653850 co:SharesIssued 2013-02-01", "Home Archive Contacts Careers Quotes Sitemap Suppliers", "list of subsidiaries in Tortowick"):
        assert quality.prose_chars([above] * 3 + [said]) == len("".join(said.split()))
    wrapped = ["We had 5,213 employees in our pet nutrition operations, of whom", "2,917 worked at the northern site, although", "headcount stayed unexpected."]
    assert quality.prose_chars(wrapped) == len("".join("".join(wrapped).split()))
