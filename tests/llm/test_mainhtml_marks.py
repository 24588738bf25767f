"""Pages that leave out end tags or wrap everything in a form keep their article."""

import pytest

from plumbline.llm import mainhtml

STORY = "<h1>Title</h1><p>First &amp; long paragraph of the story.</p><p>Second paragraph, with <b>bold</b> words.</p>"
WANT = "Title\nFirst & long paragraph of the story.\nSecond paragraph, with bold words."


def text(page):
    return mainhtml.article(mainhtml.parse(page)[0], set())


@pytest.mark.parametrize("page", [
    f"<html><head><title>x</title></head><body><form id='aspnetForm'><nav><a href=/>Home</a></nav><article>{STORY}</article><input name=a></form></body></html>",
    f"<html><body><form action=/p method=post><div>{STORY}</div></form><footer><p>&copy; us</p></footer></body></html>",
    f"<html><head><title>x</title><meta charset=utf-8><body><article>{STORY}</article></body></html>",
    f"<html><head><title>x</title><article>{STORY}</article></html>",
    f"<html><head><title>x</title><link rel=a href=b><p>{STORY[4:]}".replace("Title</h1>", "Title</p>"),
    f"<html><body><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul><article>{STORY}</article></body></html>",
    f"<html><body><nav><a href=/>Home</a></nav><aside><p>Side</p><main>{STORY}</main></body></html>",
    f"<html><body><header><h2>Site</h2><div role=main>{STORY}</div></body></html>"],
    ids=["form around the page", "form without an article", "no end of head", "no body either", "paragraphs after the head", "open navigation", "open aside before main", "open header before main"])
def test_articles_survive(page):
    assert text(page) == WANT


@pytest.mark.parametrize("page", [
    f"<body><form><p>Search here</p><input></form><article>{STORY}<form><p>Your comment</p><textarea></textarea></form></article></body>",
    f"<body><nav><article><p>Card</p></article></nav><article>{STORY}</article><aside><article><p>Teaser</p></article></aside></body>",
    f"<head><title>x</title><style>p {{}}</style><script>1</script></head><body><footer><p>Foot</p></footer><main>{STORY}</main></body>"],
    ids=["forms beside and inside", "cards in closed elements", "closed head"])
def test_what_is_not_the_article_still_goes(page):
    assert text(page) == WANT


def test_a_page_of_some_megabytes():
    long = "".join(f"<p>Paragraph {i} says something.</p>" for i in range(60_000))
    page = f"<head><title>t</title><body><form><nav><a href=/>Home</a><article>{long}</article></form>"
    assert len(page) > 2_000_000 and text(page) == "\n".join(f"Paragraph {i} says something." for i in range(60_000))
