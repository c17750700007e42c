import textwrap

from folioscope.llm.license_scans import find_licenses
from folioscope.llm.templates import LICENSES

NOTICE = LICENSES[2][1]
PROSE = " ".join(f"the river{i} runs under the old bridge{i} of the town{i}" for i in range(60)) + "."


def test_wrapped_and_embedded_notices(docs_of, shipped):
    templates = shipped.createDataFrame(LICENSES, "license_id string, text string")
    wrapped = "\n".join(textwrap.wrap(NOTICE, 72))
    texts = [
        PROSE + "\n" + wrapped + "\n" + PROSE,
        PROSE + NOTICE + " " + PROSE,
        PROSE,
        "first\n" + PROSE + "Released under the MIT License. " + PROSE + "Licensed under CC BY 4.0. " + PROSE,
        "\n".join(["# " + line for line in textwrap.wrap(LICENSES[6][1], 70)]) + "\n" + PROSE,
        "\n".join([PROSE, "Released under the MIT License.", PROSE]),
        wrapped,
        PROSE + "\n" + wrapped.replace("obtaining", "getting").replace("furnished", "given") + "\n" + PROSE + "\n" + wrapped,
    ]
    rows = [(r.doc_id, r.line, r.license_id) for r in find_licenses(docs_of(texts), templates).collect()]
    gpl = 4, 1, "GPL-3.0"
    n = len(wrapped.split("\n"))
    want = [(0, 2, "MIT"), (1, 1, "MIT"), (3, 2, "CC-BY-4.0"), (3, 2, "MIT"), gpl, (5, 2, "MIT"), (6, 0, "MIT"), (7, 2, "MIT"), (7, n + 3, "MIT")]
    assert sorted(rows) == want
