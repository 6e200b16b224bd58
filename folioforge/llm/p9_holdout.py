"""Hand-written and hand-checked texts for calibrating the quality model (never trained on unless a corpus lacks a class)."""

_P1 = "The harbour was quiet in the morning. Two boats came in before noon, and the crews carried the crates up the hill. Nobody asked what was in them."
_P2 = "오늘 아침에는 비가 많이 내렸다. 그래서 시장에 가지 못했고, 집에서 오래된 편지를 정리했다. 어머니는 그 편지를 모두 기억하고 있었다."
_P3 = "Der Zug kam eine Stunde zu spät an. Auf dem Bahnsteig warteten nur noch drei Leute, und keiner von ihnen sprach. Es war schon dunkel."
_P4 = "La maison était vide depuis des années. On disait que le vieux médecin y avait vécu, mais personne ne s'en souvenait vraiment. Le jardin avait tout envahi."
_P5 = "El mercado abría antes del amanecer. Los pescadores traían las cajas y discutían los precios con calma, porque todos se conocían. Después tomaban café."
_P6 = "川のそばに小さな工場があった。祖父はそこで三十年働き、毎日同じ道を歩いて帰った。その道は今でも残っている。"
_P7 = "Chapter 4 The Long Road\n\nShe left before the others woke. The road was dry, and the dust rose behind her like smoke.\n\n- bread\n- water\n- a map\n\nThat was all she had taken, and it had to be enough for three days of walking."
_P8 = "— Are you coming with us tonight?\n— I would like to, but the letter has to be finished before the post leaves.\n— Then we will wait for you at the bridge."
_P9 = "We walked along the river until\nthe path ended at an old mill. The\ndoor was open, and inside we found\nnothing but a broken wheel and the\nsmell of wet wood."

HOLDOUT = [
    ("prose", _P1), ("prose", _P2), ("prose", _P3), ("prose", _P4), ("prose", _P5), ("prose", _P6), ("prose", _P7), ("prose", _P8), ("prose", _P9),
    ("prose", _P1 + "\n\n" + _P1.replace("quiet", "busy")), ("prose", "## 요약\n\n" + _P2 + "\n\n## 배경\n\n" + _P2), ("prose", "It rained all day."), ("prose", "왜 아무도 오지 않았는가?"),
    ("prose", "| name | age |\n|---|---|\n| Ann | 31 |\n\n" + _P1 + " " + _P3 + " " + _P4),
    ("list", "- apples\n- pears\n- plums\n- cherries\n- a basket of nuts\n- bread"),
    ("list", "Tools\n\n• hammer\n• saw / file\n• nails\n• chisel\n• pliers / tongs\n• level"),
    ("list", "1. Introduction\n2. Method\n3. Results\n4. Discussion\n5. Outlook\n6. References"),
    ("list", "harbour, 12, 44–58\nlantern, 9, 71–80\nmarket, 3, 14–19\nmill, 22, 90–95\nriver, 5, 31–60"),
    ("list", "[1] Marlow, J. Ships of the North, 1951\n[2] Teller, A. A History of Mills, 1988\n[3] Okafor, N. Salt, 2003\n[4] Brandt, E. Night Trains, 1977"),
    ("list", "The First Winter .... 5\nA House by the Sea ...... 19\nLetters Home .... 33\nThe Return ...... 47\nAfterwards .... 61"),
    ("list", "#history #archive\n#letters\n#harbour\n#trade_routes\n#maps\n#family"),
    ("list", "사과\n배\n자두\n호두\n빵\n소금\n밀가루\n버터"),
    ("list", "□ 우유\n□ 달걀 / 빵\n□ 신문\n□ 편지 봉투\n□ 우표\n□ 연필"),
    ("list", "01 오래된 집\n02 강가의 시장\n03 돌아온 편지\n04 겨울밤\n05 마지막 기차"),
    ("list", "Things that I packed for the trip were these.\n* coat\n* boots\n* lamp\n* rope\n* knife\n* tin of tea\n* two books\n* map"),
    ("list", "die Lampe\ndas Brot\nder Hafen\ndie Brücke\ndas Segel\nder Markt\ndie Mühle"),
    ("table", "| name | height | year |\n|---|---|---|\n| mill | 12 | 1887 |\n| tower | 40 | 1901 |\n| bridge | 9 | 1923 |"),
    ("table", "harbour\t12\t1901\t3.5\nmarket\t9\t1887\tn/a\nmill\t31\t1923\t7.25\nbridge\t4\t1950\t2.1"),
    ("table", "harbour;12;1901\nmarket;9;1887\nmill;31;1923\nbridge;4;1950\ntower;8;n/a"),
    ("table", "harbour,12,1901,4.5\nmarket,9,1887,n/a\nmill,31,1923,2.25\nbridge,4,1950,9"),
    ("table", "12     1901     4.5\n9      1887     n/a\n31     1923     2.25\n4      1950     9.75"),
    ("table", "Prices of the year\nbread         1.20     1.35     1.40\nsalt          0.30     0.30     0.45\nlamp oil      2.75     2.90     n/a\nrope          4.10     4.00     4.20"),
    ("table", "항구\t12\t1901\n시장\t9\t1887\n다리\t4\t1950\n방앗간\t31\t1923"),
    ("table", "시장;31;n/a;1901\n다리;4;22;1950\n항구;9;7;1887\n등대;8;1;1923"),
    ("junk", "kfj wqrt xzlp mnbv qwrt zxcv plkj hgfd trwq mnbv cxzl kjhg fdsq wrtp zxcv bnmp lkjh"),
    ("junk", "ㅋㅋㅋ ㅋㅋ ㅋㅋㅋㅋ ㅋㅋ ㅎㅎ ㅋㅋ ㅋㅋㅋ ㅋㅋ ㅋㅋ ㅋㅋㅋㅋ"),
    ("junk", "test test test test test test test test test test test test"),
    ("junk", "aGVsbG8gd29ybGQgdGhpcyBpcyBhIGxvbmcgYmFzZTY0IGJsb2NrIHdpdGhvdXQgYW55IHJlYWRhYmxlIHdvcmRzIGluIGl0IGF0IGFsbA0KZm9vYmFyYmF6Zm9vYmFyYmF6"),
    ("junk", "□□□ □□ □□□□ □□ □□□ □□ □□□□ □□□ □□"),
    ("junk", "$%^& *()_ +=-{ }[]| :;<> ?/., ~`!@ #$%^ &*() _+=-"),
    ("junk", "T h e b o a t s c a m e i n b e f o r e n o o n a n d t h e c r e w s c a r r i e d t h e c r a t e s"),
    ("junk", "ë\x8c\x80ë¶\x80ë¶\x84ì\x9d\x98 ì°¸ì\x97¬ì\x9e\x90ì\x97\x90ê²\x8c ê¸°ë¡\x9d ë³´ê´\x80ì\x86\x8cë\x8a\x94 ì\x98¤ë\x8a\x98"),
    ("junk", "오�□ 아?□에�?비□ 많� □□렸� □?�래□?시□에 가?□□□고 �?에□ □래� 편□를"),
    ("junk", "편지 편지 편지 편지 편지 편지 편지 편지 편지 편지 편지 편지"),
]
