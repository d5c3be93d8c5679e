import pytest

from shutterstack.llm.residue import Detector, residue_documents

CELL = "array<struct<kind string, execution_count int, first_char int, n_chars int>>"

RESIDUE = [
    "# {{ title }}\n\n**By:** {{ author }}\n\n{{ summary }}", "## %PROJECT_NAME%", "## <<TITLE>>", "| Field | Value |\n|---|---|\n| contact | <<TITLE>> |\n| description | [[course]] |", "Welcome to [Insert course]! In this lesson you will learn [YOUR TOPIC].", "| Field | Value |\n|---|---|\n| title | &lt;title&gt; |\n| date | __DATE__ |", "# <title here>\n\n<summary here>",
    "- Team: ${TEAM}\n- Goal: <<goal>>", "# {% block x %}{% endblock %}\n\nThis notebook describes <%= a %> for @@b@@. Last change: [[date]].",
    "Lorem ipsum dolor sit amet consectetur adipiscing elit.", "## Introduction\n\nAliqua ut magna aute aute in cillum aute aliquip. Incididunt nulla amet amet aliqua.", "asdf asdf asdf asdf asdf", "foo bar foo bar foo bar foo bar", "## Heading goes here\n\nDouble click to edit this cell.",
    "Hier steht später der Einleitungstext. Bitte ersetzen.", "Texte provisoire à remplacer par votre introduction.",
    "<html><head><title>502 Bad Gateway</title></head><body><center><h1>502 Bad Gateway</h1></center></body></html>", "The\xa0preview\xa0could not be loaded (code 17). Go back to the overview.", "THIS PAGE TOOK TOO LONG TO RESPOND [E42].", "Erreur 404 : la page demandée est introuvable.\n\nRequest ID: 9e9d9c",
    "**The interactive table was not drawn because it depends on client-side scripting. Please switch it on.**", "<noscript>JavaScript is required to display this output.</noscript>", "Bitte aktivieren Sie JavaScript, um diesen Inhalt anzuzeigen.",
]
CONTENT = [
    "", " \n ", "## Results", "TODO: repeat this with window 4 and the noisy subset.", "The plot is interactive and needs JavaScript in the browser; a static picture follows below.",
    '> "Please enable JavaScript to continue" was the whole body of 12 crawled pages, so we removed those pages.', 'We use "lorem ipsum dolor sit amet" as a short test string to see how the tokenizer treats Latin words.',
    "When the service is busy it answers with 503 Service Unavailable, and we wait 30 seconds before asking again.", "| Code | Meaning | What we do |\n|---|---|---|\n| 404 | Not Found | drop the row |\n| 503 | Service Unavailable | wait 9 s |\n\nNote that the kiln drops after week 3.",
    "The template engine replaces `{{ title }}` with the value from the settings, so we fill it before export.", r"The set $\{\{x_i\}\}_{i<n}$ is nested: {{1, 2}, {3}} has two members.", "$$\\bar{x}_{{t}} = \\frac{1}{3}\\sum_{i} x_{t-i}$$",
    'Readers wrote that the viewer sometimes failed with "The notebook is not available right now", so the figures are saved as files too.', "Le modèle explique environ 12 % de la variance.", "word " * 50_000 + "end of a long text",
]


@pytest.fixture(scope="module")
def detector():
    return Detector()


@pytest.mark.parametrize("cell", RESIDUE)
def test_residue(detector, cell):
    assert detector.text_cell(cell)


@pytest.mark.parametrize("cell", CONTENT, ids=lambda c: c[:30])
def test_content(detector, cell):
    assert not detector.text_cell(cell)


def test_outputs(detector):
    assert detector.output_cell("⚠️ This widget requires JavaScript. Reload when ready.")
    assert detector.output_cell("Loading notebook viewer...\n(this takes a script-enabled browser)")
    for text in ("503 Service Unavailable", "Not Found https://files.example/a.csv", "Lorem ipsum dolor sit amet", "ran script.js in 3 s with 40 rows of the table left over", "x" * 100_000 + " script"):
        assert not detector.output_cell(text)


def test_long_cells_take_no_longer_by_the_square(detector):
    assert detector.text_cell("- Team: {{ team }}. Goal: ${GOAL}.\n" * 20_000)
    assert not detector.text_cell(("- Team: {{ team }}.\n" + "We plot the noisy readings before looking at the table.\n" * 3) * 5_000)


def cells(*parts):
    out, at = [], 0
    for kind, body in parts:
        out.append((kind, None, at, len(body)))
        at += len(body) + 2
    return "\n\n".join(b for _, b in parts), out


def test_documents(spark):
    notice, fine = "This page requires JavaScript. Turn it on and reload.", "We plot the noisy readings before looking at the table."
    rows = [
        (1, *cells(("code", "x = 1"), ("markdown", "😀 fine words here"), ("markdown", notice))), (2, *cells(("markdown", fine), ("code", notice))), (3, *cells(("output", notice),)), (4, *cells(("output", "404 Not Found"),)),
        (5, "", []), (6, None, None), (7, notice, None), (7, notice, None), (8, fine, [("markdown", None, 500, 10), (None, None, None, None), ("markdown", 1, 0, None)]), (None, *cells(("markdown", notice),)), (9, fine, []),
    ]
    found = [r[0] for r in residue_documents(spark.createDataFrame([(*r, 1) for r in rows], f"doc_id long, text string, cells {CELL}, kind int")).collect()]
    assert sorted(found, key=str) == [1, 3, 7, None]
    assert residue_documents(spark.createDataFrame([], f"doc_id long, text string, cells {CELL}")).count() == 0
