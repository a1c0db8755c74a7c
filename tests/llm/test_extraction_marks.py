import pytest

from tests.llm.test_extraction import MODEL, P, W


@pytest.mark.parametrize("page,want", [
    (f"<p>x <α y</p>{P}", f"x <α y\n\n{W}"), (f"<p><中文标题> a b</p>{P}", f"<中文标题> a b\n\n{W}"), (f"{P}<p>a </é> b</p>", f"{W}\n\na b"),
])
def test_other_letters_after_a_sign(page, want):
    assert MODEL.region(page) == want


@pytest.mark.parametrize("name", ["overflow-hidden", "has-sidebar", "no-sidebar", "comments-open", "has-header", "social-science"])
def test_names_that_hold_a_mark(name):
    assert MODEL.region(f"<article class='{name}'>{P}</article>") == W
    assert MODEL.region(f"<div class='page {name}'>{P}</div>") == W


def test_the_only_article_is_spared():
    assert MODEL.region(f"<div class='sidebar'><article id='comment'>{P}</article></div>") == W
    assert MODEL.region(f"{P}<div class='comments'><article>{P}</article><article>{P}</article></div>") == W
    assert MODEL.region(f"<aside><article>{P}</article></aside>") == ""
