"""A small labelled table for the block classifier: pages written for it, main text marked by a ``data-main`` attribute."""

PAGES = (
    """<html><head><title>River gauge</title></head><body><header><a href="/">Gauge Daily</a><p>News every morning</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Weather</a></li><li><a href="/c">Sport</a></li></ul></nav>
<article><h1 data-main>River gauge rises</h1><p data-main>The gauge at the old bridge rose by two metres overnight.</p>
<div class="ad">Buy new boots today, half price.</div><p data-main>Engineers, who arrived at dawn, opened the lower gates.</p>
<ul><li data-main>Open the gates</li><li data-main><a href="/log">Read the log</a></li></ul><p data-main>Done.</p>
<aside>Do you know the depth of the lake?</aside><footer>Filed under water</footer></article>
<section class="comments"><h3>Comments</h3><p>I saw the water this morning, it was quite high.</p><p>Great report, thank you.</p></section>
<footer>&copy; Gauge Daily. All rights reserved.</footer></body></html>""",
    """<body><div id="top-menu"><a href="/1">Products</a> <a href="/2">Prices</a> <a href="/3">Contact</a></div>
<div class="cookie-notice">We use cookies to make this site better. <button>Accept</button></div>
<div id="main-content"><h2 data-main>How bread is baked</h2><p data-main>Flour, water and salt are mixed, then left to rest.</p>
<blockquote data-main>Patience is the first ingredient.</blockquote><div data-main>After one night the dough has doubled, and it is shaped.</div>
<table><tr><td data-main>Rest</td><td data-main>12 hours</td></tr></table><pre data-main>mix; rest; bake</pre></div>
<div class="sidebar"><h4>Popular</h4><ul><li><a href="/x">Ten cakes for spring</a></li><li><a href="/y">Best knives</a></li></ul></div>
<form><label>Your mail</label><input><button>Subscribe</button></form><div class="footer">Imprint | Privacy</div></body>""",
    """<body><div><a href="/">Start</a> | <a href="/n">News</a> | <a href="/k">Contact</a></div><div><p data-main>The council met on Monday to
discuss the new tram line, which will connect the harbour with the university.</p><p data-main>Work starts in spring. It should
take three years, the mayor said.</p><p data-main>Costs are shared by the city and the region, as agreed last year.</p></div>
<div><a href="/p">Previous</a> <a href="/q">Next</a></div><div>Copyright Tram News</div></body>""",
    """<body><div><ul><li><a href="/">Home</a></li><li><a href="/f">Forum</a></li><li><a href="/l">Log in</a></li></ul></div>
<div><div><h1 data-main>Repairing a clock</h1><div data-main>Take the hands off first, and keep the screws in a cup.</div>
<div data-main>The spring stores a lot of force; release it slowly.</div><div data-main>Clean the wheels with a soft brush, then oil them.</div>
<h2 data-main>Putting it together</h2><div data-main>Start with the largest wheel and work towards the smallest.</div></div></div>
<div><a href="/s">Share</a><a href="/t">Print</a></div><div>&copy; 2019 Clock Friends</div></body>""",
    """<body><main><h1 data-main>Spring in the hills</h1><p data-main>Snow melts late here, often in May.</p><div class="share-buttons">
<a href="/tw">Tweet</a><a href="/fb">Post</a></div><p data-main>Flowers follow within days, yellow first, then blue.</p>
<nav><a href="#a">Contents</a><a href="#b">Top</a></nav><figure><figcaption data-main>A meadow in June, seen from the east.</figcaption></figure>
<div id="comments"><div class="comment">Lovely pictures, where was this taken?</div><div class="comment">I was there, it was cold.</div></div>
</main><aside class="related"><h3>Related</h3><p>Autumn in the hills brings fog, rain and quiet paths.</p></aside></body>""",
    """<body><div class="banner">Summer sale! All shoes must go, up to fifty percent off.</div><div class="post"><div class="entry">
<p data-main>Short note.</p><p data-main>Our library opens at nine, and closes at six.</p><p data-main>See <a href="/m">the map</a> for parking.</p></div>
<div class="advertisement"><p>Cheap flights to the sea, book now and save.</p></div><p data-main>On Sundays it stays closed.</p></div>
<div class="newsletter">Get our letter every week, free of charge.</div><div role="contentinfo">Terms, conditions and opening hours.</div></body>""",
    """<body><header><h1>The Valley Post</h1></header><div role="navigation"><a href="/1">One</a><a href="/2">Two</a></div>
<section><article><header><h1 data-main>Bees return</h1></header><p data-main>After a hard winter the bees are back in the valley.</p>
<p data-main>Yes.</p><p data-main>Growers expect a good year; apples need them most.</p><form><p>Tell us what you think about bees.</p></form>
</article></section><div class="promo">Try our honey, sent to your door.</div><footer><p>Write to us, we answer every letter.</p></footer></body>""",
    """<body><p data-main>A plain page has no menus at all, only a few paragraphs of text.</p><p data-main>This is the second one.</p>
<p data-main>The third ends it.</p></body>""",
    """<body><table><tr><td><a href="/1">Index</a><br><a href="/2">Archive</a><br><a href="/3">Links</a></td><td><h1 data-main>Old paths</h1>
<p data-main>The path over the ridge was used by traders, smugglers and later by soldiers.</p><p data-main>Today walkers follow it,
and a hut offers soup and a bed.</p></td></tr></table><p><a href="/mail">Mail</a> <a href="/top">Top</a></p></body>""",
    """<body><div class="notice">This site will be down on Friday night.</div><div class="search">Search the archive</div><div class="content">
<h1 data-main>Salt and trade</h1><p data-main>Salt was once worth its weight in silver, or so the story goes.</p><ol><li data-main>Boil the brine.</li>
<li data-main>Skim it, then wait.</li></ol></div><div class="tags"><a href="/t">salt</a> <a href="/u">trade</a></div></body>""",
)
