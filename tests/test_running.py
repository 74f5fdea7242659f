"""Running lines on one side, in fragments and on all pages, and what must stay."""

from siltstone.operators import running

SCHEMA = "document_id string, page_id long, page_number int, text string"


def body(i):
    return f"Body sentence {'abcdefghijk'[i] * 9} of the page"


def rows():
    out = []
    for i in range(11):
        head = "Northern Harbour Review" if i % 2 else "| table | row"
        cut = 4 + i % 3
        foot = "Quarterly Shipping Bulletin"
        out.append(("d", i, i + 1, f"{head}\r\n{body(i)}\n\n{foot[:cut]}\n{foot[cut:]}"))
    out += [("d2", 20 + i, i + 1, f"Northern Harbour Review\n{body(i)}") for i in range(3)]  # too few pages
    out += [("d3", 30 + i, i + 1, (f"Repeated in the body\n{body(i)}" if i in (0, 1, 2) else body(i))) for i in range(8)]  # on both sides, under half
    out += [("d4", 40 + i, i + 1, None if i == 3 else f"Short line\n{'long ' * 13}\nOn every page but one\n{body(i)}") for i in range(4)]
    return out + out[:3]


def test_keys(spark):
    found = {(r.document_id, r.line_key): (r.pages, r.side) for r in running.running_keys(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert found["d", "northernharbourreview"] == (5, "verso")
    assert found["d", "quarterlyshippingbulletin"] == (11, "both")
    assert found["d4", "oneverypagebutone"] == (3, "both")
    assert not {d for d, _ in found} & {"d2", "d3"} and ("d4", "shortline") not in found


def test_pages(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    clean = {r.page_id: r.clean_text for r in running.clean_pages(df, running.running_keys(df)).collect()}
    given = {r[1]: r[3] for r in rows()}
    assert len(clean) == len(given)
    for i in range(11):
        assert clean[i] == (body(i) if i % 2 else f"| table | row\n{body(i)}")
    for i in [*range(20, 23), *range(30, 38)]:
        assert clean[i] == given[i]
    assert clean[43] is None and "On every page" not in clean[40] and clean[40].endswith(body(0))
