"""Names of elements do not cost an article its text."""

import pytest

from meterline.llm.html_text import main_text

BODY = "<p>First paragraph, with some commas, and enough words to count.</p><p>Second paragraph, which is long enough, surely.</p>"
TEXT = "First paragraph, with some commas, and enough words to count.\n\nSecond paragraph, which is long enough, surely."
COMMENTS = "<div class=comments><p>Reader says, something, with many commas.</p></div>"


@pytest.mark.parametrize("page, text", [
    (f"<body><div class='layout has-sidebar'>{BODY}</div></body>", TEXT),
    (f"<body><form id=aspnetForm><div>{BODY}</div></form></body>", TEXT),
    (f"<body><div class='sidebar-layout'><article>{BODY}</article>{COMMENTS}</div></body>", TEXT),
    (f"<body><article><h2 id=search-results>Results</h2>{BODY}<h2 id=tabs-and-spaces>Tabs</h2></article></body>", f"Results\n\n{TEXT}\n\nTabs"),
    (f"<body><article>{BODY}<section id=discussion><h2>Discussion</h2><p>We discuss it.</p></section></article></body>", f"{TEXT}\n\nDiscussion\n\nWe discuss it."),
    (f"<body><article>{BODY}</article>{COMMENTS * 9}<div class='sidebar'>Side, text, here.</div><form>Your name</form></body>", TEXT),
])
def test_named_elements(page, text):
    assert main_text(page) == text
