import re
from collections import defaultdict

from ledgerloom.llm import sitelines

NOTICE = "Printed for holders of Acme common shares only"


def data():
    filings, sections = [], []
    for n in range(12):
        acc = f"0000000007-20-{n:06}"
        filings.append((acc, ["7", "CIK 0000000007", " 0000000007 "][n % 3]))
        lines = [f"Opening line of filing number {'abcdefghijkl'[n] * 6} here", "short", f"– {n} – {NOTICE}{'' if n % 2 else ' |'}", ""]
        if n < 5:
            lines.append("This line stands in five filings of twelve")
        if n < 4:
            lines.append("This line stands in four filings of twelve")
        sections.append((f"{acc}:a", acc if n % 2 else acc.replace("-", ""), "\n".join(lines)))
        sections.append((f"{acc}:b", acc, NOTICE.upper() + "\r\nbody text of its own " + "xyzabcdefghi"[n] * 5))
    filings += [("0000000008-20-000001", None), ("0000000008-20-000002", " ")] + [filings[0]]
    sections += [("0000000008-20-000001:a", "0000000008-20-000001", NOTICE), ("x:a", "bad", NOTICE), ("y:a", None, NOTICE), ("z:a", "0000000099-20-000001", NOTICE)]
    sections += [sections[0], (None, sections[0][1], NOTICE), ("0000000007-20-000011:c", "0000000007-20-000011", None), ("0000000007-20-000011:d", "0000000007-20-000011", "")]
    return sections, filings


def brute(sections, filings):
    cik = {}
    for a, c in filings:
        if c and c.strip():
            cik[re.sub(r"\D", "", a)] = int(re.sub(r"\D", "", c))
    seen, site, places = defaultdict(set), defaultdict(set), []
    for key, acc, text in sections:
        a = re.sub(r"\D", "", acc or "")
        if a not in cik:
            continue
        site[cik[a]].add(a)
        for n, line in enumerate(text.split("\n") if text is not None else []):
            letters = "".join(c for c in line.lower() if c.isalpha())
            if len(letters) >= 20:
                seen[cik[a], letters].add(a)
                places.append((key, n, cik[a], letters))
    return {(k, n) for k, n, c, x in places if len(seen[c, x]) >= 5 and len(seen[c, x]) >= 0.4 * len(site[c])}


def frames(spark):
    sections, filings = data()
    s = spark.createDataFrame([(*r, 5, 6) for r in sections], "section_id string, accession string, text string, cik int, line int")
    return s, spark.createDataFrame([(*r, "t") for r in filings], "accession string, cik string, text string"), sections, filings


def test_places(spark):
    s, f, sections, filings = frames(spark)
    got = [tuple(r) for r in sitelines.recurring_line_places(s, f).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(sections, filings)
    assert ("0000000007-20-000000:a", 2) in got and ("0000000007-20-000000:b", 0) in got and ("0000000007-20-000000:a", 4) in got and ("0000000007-20-000000:a", 5) not in got


def test_removal(spark):
    s, f, *_ = frames(spark)
    out = {r.section_id: r for r in sitelines.without_recurring_lines(s, f).collect()}
    assert out["0000000007-20-000000:b"].text.startswith("body text") and out["0000000007-20-000000:b"].n_removed == 1
    assert out["0000000007-20-000011:c"].text is None and out["x:a"].text == NOTICE and out["x:a"].n_removed == 0


def test_empty(spark):
    s, f, *_ = frames(spark)
    assert sitelines.recurring_line_places(s.limit(0), f).collect() == [] == sitelines.recurring_line_places(s, f.limit(0)).collect()
