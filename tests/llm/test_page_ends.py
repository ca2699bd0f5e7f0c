"""Text after and within elements that were once cut with all that follows."""

import pytest

from motecraft.llm import html_crf


@pytest.mark.parametrize("tag", ['<svg class="icon"/>', "<math/>", "<svg><title/><path d='m 0/'/></svg>", "<svg>", "<select>", "<object>", "<noscript>", "<template>", "<svg><g>"])
def test_text_after_elements_without_an_end_stays(tag):
    assert [b.text for b in html_crf.blocks(f"<p>one {tag}</p><p>two</p><p>three")] == ["one", "two", "three"]


def test_text_of_math_and_examples_stays():
    page = "<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be<xmp>if a <b> &amp; c</xmp>end<script>no</script><svg><style/></svg> it"
    assert [b.text for b in html_crf.blocks(page)] == ["let x=2 be", "if a <b> &amp; c", "end it"]
    assert [b.text for b in html_crf.blocks("<p>a<svg class=icon/>b</svg>c")] == ["abc"]


def test_the_field_labels_what_follows():
    told = "The committee met again on Tuesday, and its members agreed to wait for the report before any vote."
    page = f'<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>A report</h1><p>{told}</p><p><svg class="icon"/>{told}</p><p>{told}</p></article></body></html>'
    assert html_crf.default_field().extract(page).count(told) == 3
