"""Labelled pages (written for this purpose): html, and the first and last words of the main text."""

_P = "<p>{}</p>"
_LONG = "The river rose in the night and by the morning the lower fields were under water, while the road to the mill stayed open for carts."
_MORE = "Farmers moved their cattle to the hill, and nobody was hurt, although two barns were lost and a bridge will need new beams."

LABELLED: tuple[tuple[str, str, str], ...] = (
    (
        '<html><head><title>t</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'
        f'<div class="ad">Buy one get one free today only.</div><article><h1>Flood in the valley</h1>{_P.format(_LONG)}{_P.format(_MORE)}<p>More soon.</p></article>'
        "<footer>&copy; The Valley Post. All rights reserved.</footer></body></html>",
        "Flood in the valley",
        "More soon.",
    ),
    (
        '<body><div id="header"><a href="/">Logo</a> <a href="/login">Log in</a></div><div id="content"><h2>A note on bread</h2>'
        f'<p>{_LONG} <a href="/x">Read the recipe</a> before you start.</p><ul><li>Flour and water</li><li>Salt</li></ul>{_P.format(_MORE)}</div>'
        '<div class="sidebar"><h3>Popular</h3><ul><li><a href="1">Ten cakes</a></li><li><a href="2">Five pies</a></li></ul></div>'
        '<div class="comments"><p>Great post!</p><p>I tried it and it works.</p></div></body>',
        "A note on bread",
        _MORE,
    ),
    (
        '<body><div class="cookie-notice">We use cookies to improve your visit. <button>Accept</button></div><main><h1>Minutes of the meeting</h1>'
        f"{_P.format(_LONG)}<blockquote>We will build again, said the mayor of the town.</blockquote>{_P.format(_MORE)}</main>"
        '<form action="/s"><label>Your mail</label><input><button>Subscribe</button></form><aside><p>About the author: she writes.</p></aside></body>',
        "Minutes of the meeting",
        _MORE,
    ),
    (
        '<body><ul class="menu"><li><a href="a">One</a></li><li><a href="b">Two</a></li><li><a href="c">Three</a></li><li><a href="d">Four</a></li></ul>'
        f'<table><tr><td><p>{_LONG}</p><p>{_MORE}</p><p>{_LONG}</p></td></tr></table><div class="related"><a href="e">Next story of the day</a></div><footer>Contact us</footer></body>',
        _LONG,
        _LONG,
    ),
    (
        '<body><p>The Valley Post, founded long ago</p><p>Today: rain and wind</p><ul><li><a href="a">Front page</a></li><li><a href="b">Sport pages</a></li><li><a href="c">Letters page</a></li></ul>'
        f'<main><h1>The mill will stay</h1>{_P.format(_LONG)}{_P.format(_MORE)}</main><p>Printed by hand in the old town</p><p>Call us any day before noon</p></body>',
        "The mill will stay",
        _MORE,
    ),
    (
        '<body><p><a href="a">Home of the post</a></p><p><a href="b">Weather this week</a></p><p><a href="c">All of the letters</a></p><p><a href="d">Buy an old copy</a></p>'
        f'<h2>Bread prices rise</h2>{_P.format(_LONG)}{_P.format(_MORE)}<p><a href="e">Older stories here</a></p><p><a href="f">Newer stories here</a></p></body>',
        "Bread prices rise",
        _MORE,
    ),
)
