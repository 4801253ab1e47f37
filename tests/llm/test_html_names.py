"""Names of boxes are a prior, not a verdict; work does not grow with depth."""

import time

import pytest

from onsetry.llm.html_text import main_text

LINE = "One two three, four five six seven, eight nine ten eleven twelve, thirteen. " * 4
TEXT = " ".join(LINE.split())
BODY = f"<p>{LINE}</p>" * 3


@pytest.mark.parametrize(("page", "want"), [
    (f'<div class="main-content sidebar-right">{BODY}</div>', " ".join([TEXT] * 3)),
    (f'<div class="page-header-fixed">{BODY}</div>', " ".join([TEXT] * 3)),
    (f'<article><div class="social-science">{BODY}</div></article>', " ".join([TEXT] * 3)),
    (f'<article><div class="entry-header"><h1>Head line</h1></div>{BODY}</article>', " ".join(["Head line", *[TEXT] * 3])),
    (f'<article>{BODY}<p id="notice">A paragraph with an anchor.</p></article>', " ".join([*[TEXT] * 3, "A paragraph with an anchor."])),
    (f'<article>{BODY}</article><div class="comments">{BODY}</div>', " ".join([TEXT] * 3)),
    (f'<article>{BODY}<div class="related"><p>Read this, and that, too.</p></div></article>', " ".join([TEXT] * 3)),
    (f'<div class="sidebar"><p>Some, links, here.</p></div><div id="main">{BODY}</div>', " ".join([TEXT] * 3)),
])
def test_names(page, want):
    assert main_text(f"<html><body>{page}</body></html>") == want


def test_deep_and_long_pages():
    def seconds(n):
        start = time.perf_counter()
        assert main_text("<div>" * n + BODY + "</div>" * n) == " ".join([TEXT] * 3)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(16_000) < 16 * 3 * max(seconds(1000), 0.01)
    assert len(main_text(f"<body><article>{BODY * 5000}</article></body>")) == 15_000 * (len(TEXT) + 1) - 1
