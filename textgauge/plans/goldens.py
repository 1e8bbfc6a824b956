"""Published expectations of the normalizers: language, white space stripped or not, text, normal form. Fixed values."""

GOLDENS: dict[str, list[tuple[bool, str, str]]] = {
    "en": [(False, a, b) for a, b in (("seventy-eight", "78"), ("twentieth century", "20 century"), ("103rd", "103"), ("1960s", "1960s"), ("1,000,000", "1000000"), ("25-30", "25 30"), ("don't", "do not"), ("Wait... what?", "wait what"))],
    "de": [(False, a, b) for a, b in (("einundzwanzig", "21"), ("dreiunddreißigtausend", "33000"), ("im Jahr neunzehnhundertneunundneunzig", "im jahr 1999"), ("hundertdritte", "103"), ("33'000", "33000"), ("33.000,50", "33000.50"), ("dreihunderttausend", "dreihunderttausend"), ("die achtziger Jahre", "die achtziger jahre"), ("eines Tages", "eines tages"), ("acht", "8"))],
    "es": [(False, a, b) for a, b in (("setenta y ocho", "78"), ("mil un libros", "1001 libros"), ("noventa y nueve mil novecientos noventa y nueve", "99999"), ("20ª", "20"), ("3,14", "3.14"), ("un", "un"), ("uno", "1"), ("cuarta", "cuarta"), ("décimo quinto", "15"))],
    "fr": [(False, a, b) for a, b in (("soixante-quinze", "75"), ("vingt et un", "21"), ("quatre-vingt-dixième", "90"), ("deux cent mille cinq", "deux cent mille cinq"), ("1 000 000", "1000000"), ("dix 3000", "10 3000"), ("en 2026 trois cents personnes", "en 2026300 personnes"), ("un", "un"), ("cent un", "101"), ("second", "second"), ("2e", "2"))],
    "pt": [(False, a, b) for a, b in (("setenta e oito", "78"), ("dezesseis", "16"), ("mil novecentos e oitenta e quatro", "1984"), ("cem mil", "cem mil"), ("20º", "20"), ("quarta", "quarta"), ("décimo quarto", "décimo quarto"), ("dois e três", "2 e 3"), ("d'água", "d'água"))],
    "ru": [(False, a, b) for a, b in (("сто двадцать пять", "125"), ("тысяча девятьсот восемьдесят четыре", "1984"), ("пять сто", "5 100"), ("он остался один", "он остался 1"), ("двадцатый век", "двадцатый век"), ("две тысячи двадцать шестой", "две тысячи двадцать шестой"), ("пятьюдесятью", "пятьюдесятью"), ("Ёлка", "елка"))],
    "vi": [(False, a, b) for a, b in (("hai mươi mốt", "21"), ("ba trăm hai mươi mốt", "321"), ("hai nghìn lẻ năm", "2005"), ("33.000", "33000"), ("một trăm nghìn", "một trăm nghìn"), ("một hai ba", "một hai ba"), ("hai trăm ba", "hai trăm ba"), ("ngày thứ tư", "ngày thứ tư"), ("một mươi", "một mươi"), ("don't", "don't"))],
    "id": [(False, a, b) for a, b in (("dua puluh satu", "21"), ("sebelas", "11"), ("seratus lima", "105"), ("sembilan puluh sembilan ribu sembilan ratus sembilan puluh sembilan", "99999"), ("3.5", "3 5"), ("ketiga", "ketiga"), ("dua seribu", "dua seribu"), ("satu-satunya", "satu satunya"))],
    "ko": [(False, a, b) for a, b in (("삼만삼천", "33000"), ("만삼천", "13000"), ("3천500", "3500"), ("제삼십오", "제35"), ("이십오 명", "25 명"), ("십만", "십만"), ("만만", "만만"), ("돌연변이만이 남는다", "돌연변이만이 남는다"), ("오만의 수도", "오만의 수도"), ("약3만", "약30000"))],
    "ja": [(False, "七十八", "78"), (False, "二〇二六", "2026"), (False, "第二十", "第20"), (False, "三万三千円", "33000円"), (False, "10万", "10万"), (False, "二日前のこと", "二日前のこと"), (False, "彼が一番だ", "彼が一番だ"), (False, "三万 三千", "30000 3000"), (True, "三万 三千", "33000"), (True, "4 万年前", "4万年前"), (True, "4万年前", "40000年前")],
    "zh": [(False, "两千", "2000"), (False, "二十一个", "21个"), (False, "十万", "十万"), (False, "我们一起去", "我们一起去"), (False, "两个人", "两个人"), (True, "人口数量不足 4 万。", "人口数量不足4万"), (True, "万 一 下 雨", "万一下雨")],
    "th": [(False, "๓๓,๐๐๐", "33000"), (False, "ร้อยเอ็ด", "101"), (False, "ยี่สิบเอ็ด", "21"), (False, "เอ็ด", "เอ็ด"), (False, "ห้ามเข้า", "ห้ามเข้า"), (False, "สามัญ", "สามัญ"), (False, "สิบเอก", "สิบเอก"), (False, "มียี่สิบยี่ห้อ", "มี20ยี่ห้อ"), (True, "สามหมื่น สามพัน", "33000")],
}

#: Reference, hypothesis, sub, del, ins, length: alignments of words, and of characters where there is no space.
ALIGNMENTS = [
    ("a b c", "a x c", 1, 0, 0, 3), ("a b", "a b c", 0, 0, 1, 2), ("a b c", "a c", 0, 1, 0, 3), ("a b c", "a b c", 0, 0, 0, 3),
    ("a b c", "", 0, 3, 0, 3), ("", "", 0, 0, 0, 0), ("a b", "b a", 2, 0, 0, 2),
]

#: Rule, text, result of the single rules.
RULES = [
    ("comma_groups", "1,2,3,4 33,000", "1234 33000"), ("comma_groups", "a, b", "a, b"), ("point_groups", "33.000 3.14 1.234.567", "33000 3.14 1234567"),
    ("decimal_comma", "3,14 und 2,5", "3.14 und 2.5"), ("ordinals_en", "the 21st and 103rd of 1960s", "the 21 and 103 of 1960s"), ("ordinals_es", "20o 3a 7as", "20 3 7"),
    ("thai_digits", "๓๓๐", "330"), ("yo", "ёлка", "елка"), ("one_space", "  a \t b ", "a b"), ("blank_marks", "a-b, c!", "a b  c "),
]
