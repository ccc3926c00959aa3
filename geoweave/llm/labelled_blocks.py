"""Hand-labelled text blocks of page layouts: elements around the block with their classes, words, words inside links, and 1 if the block belongs to the article."""

LABELLED = """
nav>ul>li 1 1 0
nav>ul>li 1 1 0
nav>ul>li 2 2 0
div.ad 9 0 0
article>h1 9 0 1
article>p 48 0 1
article>p 1 0 1
article>p 6 0 1
article>p 120 3 1
article>p 3 0 1
footer 14 0 0

header>div.masthead 3 3 0
nav.main-menu>ul>li 1 1 0
nav.main-menu>ul>li 1 1 0
div.cookie-notice>p 21 2 0
main>article>h1 6 0 1
main>article>div.byline 5 1 1
main>article>p 70 0 1
main>article>h2 4 0 1
main>article>p 33 8 1
main>article>ul>li 7 0 1
main>article>ul>li 2 0 1
main>article>ul>li 5 5 1
main>article>p 18 0 1
main>article>div.share>span 4 4 0
main>section.comments>h3 2 0 0
main>section.comments>div.comment>p 44 0 0
main>section.comments>div.comment>p 12 0 0
aside>h3 2 0 0
aside>p 30 0 0
footer>p 9 2 0

div>a 1 1 0
div>a 2 2 0
div>a 1 1 0
h1 7 0 1
p 64 0 1
p 15 0 1
p 71 4 1
p 29 0 1
div>p 2 2 0
div>p 3 3 0
div>p 8 4 0

table>tr>td 1 1 0
table>tr>td 2 2 0
table>tr>td 1 1 0
table>tr>td>h1 5 0 1
table>tr>td>p 90 0 1
table>tr>td>p 41 2 1
table>tr>td>p 22 0 1
table>tr>td 3 3 0
table>tr>td 2 2 0
table>tr>td 6 0 0

article>header>h1 8 0 1
article>header>h1 3 0 1
article>p 88 0 1
article>p 5 0 1
article>div>p 7 0 1
article>div>p 31 31 1
article>div>p 9 0 1
article>footer>p 12 2 0
section.signup>p 24 0 0
div.legal>p 35 1 0
div.banner>p 5 0 0

nav>ul>li 1 1 0
nav>ul>li 3 3 0
div.ad 40 0 0
article>h1 12 0 1
article>p 150 0 1
article>p 90 0 1
div.ad 8 0 0
article>p 200 0 1
article>p 1 0 1
footer 50 1 0

div.header>p 70 0 0
div.notice>p 12 0 0
div.text>p 80 0 1
div.text>p 66 1 1
div.text>p 14 0 1
div.text>p 72 0 1
div.ads>p 20 0 0
div.text>p 110 0 1
div.footer>p 10 1 0

header>p 6 0 0
header>p 10 0 0
article>p 160 0 1
article>p 4 0 1
article>aside>p 18 0 0
article>p 140 0 1
article>form>p 9 0 0
article>p 77 0 1
article>section.comments>article.comment>p 90 0 0
article>section.comments>article.comment>p 7 0 0
div.legal>p 120 0 0

div.cookie>p 31 1 0
div.promo>p 13 0 0
div>p 88 0 1
div>p 10 0 1
div>p 67 0 1
ul>li 2 2 0
ul>li 1 1 0
ul>li 2 2 0
div>p 5 0 0

nav>ul>li 2 2 0
article>h1 6 0 1
article>p 33 0 1
article>p 2 0 1
article>p 51 0 1

main>h1 5 0 1
main>p 27 1 1
main>p 1 0 1

aside.related>h2 5 0 0
aside.related>p 14 9 0
div>h1 7 0 1
div>p 95 0 1
div>p 1 0 1
div>p 64 0 1

div.menu>a 1 1 0
div.content>h1 6 0 1
div.content>p 58 0 1
div.content>p 4 4 1
div.content>p 3 3 1
div.content>p 2 0 1
aside>h3 6 6 0
aside>h3 9 9 0
section.comments>h2 4 0 0
section.comments>div>p 33 0 0
section.comments>h3 5 0 0

article>h1 4 0 1
article>p 20 20 1
article>p 3 3 1
article>p 46 2 1
article>p 6 6 1
footer>h4 3 0 0
footer>h4 4 4 0
footer>p 5 5 0

header>h2 6 6 0
header>h2 5 0 0
div>p 44 0 1
div>h2 4 0 1
div>p 37 0 1
div>p 58 2 1

div.banner>h2 5 0 0
div.banner>p 9 0 0
main>p 17 0 1
main>div.newsletter>h3 6 0 0
main>div.newsletter>p 12 0 0
main>p 23 0 1

div>p 20 0 0
div>a 2 2 0
article>header>h1 8 0 1
article>header>p 6 0 0
article>p 80 0 1
article>p 7 0 1
div>p 60 0 0
div>p 12 0 0

p 9 1 0
div>span 45 0 0
main>header>h1 7 0 1
main>header>h2 12 0 1
main>p 100 0 1
main>p 40 0 1
div>p 33 0 0

div>p 25 1 0
header>h2 6 0 0
article>h2 9 0 1
article>p 66 0 1
div>p 90 2 0

header>h1 6 0 0
div.post>header>h1 6 0 1
div.post>p 50 0 1
div.post>p 6 0 1
div>p 30 0 0

article>h1 14 0 1
article>p 61 0 1
article>p 30 0 1

article>h1 9 0 1
article>p 83 0 1
article>p 12 0 1

div.ad 12 0 0
article>p 70 0 1
article>p 1 0 1

p 30 0 1
p 60 0 1
p 20 0 1

nav>ul>li 3 3 0
div.links>a 2 2 0
div.links>a 2 2 0
div>h1 6 0 1
div>p 21 0 1
div>p 50 0 1

ul>li 1 1 0
h1 7 0 1
p 4 0 1
div>p 60 12 1
div>p 40 14 1

ul>li 2 2 0
div>h1 5 0 1
div>p 1 0 1
div>p 25 5 1
"""
