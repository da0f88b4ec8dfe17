"""The encoding of a file, from all of its lines.

Lines that are no UTF-8 are counted as pairs of bytes, 65,536 bins whatever the file's size,
and read as each double-byte encoding. An encoding's likelihood is that of what the bytes
would say: for one byte a letter, the chance of a letter after another in a language that is
written so; for two, the chance of a character in its language. The likeliest encoding is
taken if it fits all bytes, says something likely at all, and is ahead of every other that would
read the same bytes differently. Otherwise the file is refused: its reader can name the encoding.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.errors import ParseError

#: What models learn from: a few sentences and names of each language.
SAMPLES = {
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Où ça, voilà, naïve, cœur, août, François, Hélène, Noël, forêt, café au lait, élève, été, Émile, À bientôt, réponse, société, français, garçon, École",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. Straße, größer, für, Müller, Jäger, schön, Öl, Übung, Köln, Ärzte, müssen, können, über, Schröder, groß, Björn, süß, Mädchen, Grüße, ein Café und Straßen",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. España, niño, año, mañana, corazón, José, María, Muñoz, González, Peña, ¿qué más?, ¿dónde?, ¡está!, Martínez, Pérez, también, información, Núñez, señor, García, Ángel, Agüero, pingüino",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. São João, ação, não, coração, Gonçalves, pão, informações, você, está, também, três, avó, Antônio, Conceição, Araújo, à noite, é, José",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Perché la città è più così, già università, libertà, società, può, sarà, lunedì, caffè, qualità, né, perciò, È vero, Niccolò",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap. Åsa, Örebro, på, små, Malmö, Göteborg, för, år, Björn, Sjöberg, Åkesson, Östersund, från, också",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. Både København, Søren, Østergård, ærlig, på, også, år, først, Jørgensen, Kjær, Ærø, Åse, været, måske",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Łódź, Kraków, żółw, źdźbło, Wałęsa, święta, ćma, Śląsk, dzień, Michał, Małgorzata, Żółkiewski, następne, źródło, książka, że, być, już, także, Paweł, Łukasz, Gdańsk",
    "cs": "Všichni lidé se rodí svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Příliš žluťoučký kůň úpěl ďábelské ódy. Dvořák, Čeněk, Šárka, Řehoř, Žižka, město, být, že, který, také, již, při, může, Novák, Tomáš, Jiří, Ostravě, Plzeň",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Árvíztűrő tükörfúrógép, Kovács, Szűcs, Győr, Erdős, nő, idő, ügy, és, több, első, László, Zoltán, Őszi, Gábor, György, Tamás, Éva, fő, belőle, közötti",
    "ro": "Toate fiinţele umane se nasc libere şi egale în demnitate şi în drepturi. Ele sunt înzestrate cu raţiune şi conştiinţă şi trebuie să se comporte unele faţă de altele în spiritul fraternităţii. Bucureşti, Ştefan, Ţară, mâine, când, până, după, însă, Brăila, Timişoara, Constanţa",
    "hr": "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva. Đorđe, Šibenik, Čakovec, Žagar, Petrović, kuća, što, više, može, već, riječ, Marković, Jurić",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Съешь же ещё этих мягких французских булок да выпей чаю. Москва, Иванов, Пётр, Сергеевич, Анна, Юлия, Фёдор, Эльвира, Щукин, Имя, город, привет всем людям, Санкт-Петербург, улица, Смирнова, Кузнецов, Екатерина, не, на, что, как, это, Дмитрий, Александр, Мария, телефон, адрес",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. Київ, Україна, їжак, є, ґанок, Шевченко, Ім'я, місто, Львів, її, що, як, Олександр, Наталія, вулиця, Харків",
    "bg": "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство. България, София, Георги, Димитров, Иванова, град, улица, съм, това, който, Пловдив, Първанов",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Αθήνα, Γιώργος, Παπαδόπουλος, Μαρία, Ελλάδα, Νίκος, ΑΘΗΝΑ, ώρα, ύδωρ, Θεσσαλονίκη, όνομα, πόλη, Δημήτρης, Κώστας, Ελένη, Άννα, καλημέρα",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. ירושלים, תל אביב, משה כהן, דוד לוי, שרה, שלום, שם, עיר, חיפה, יוסף, רחל, אברהם, מזרחי, טלפון, כתובת, ישראל",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. محمد، أحمد، فاطمة، القاهرة، عبد الله، الاسم، المدينة، مرحبا، علي، حسن، العنوان، الرياض، بغداد",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ กรุงเทพมหานคร สมชาย สวัสดี ประเทศไทย ชื่อ นามสกุล ที่อยู่ โทรศัพท์ เชียงใหม่ สมหญิง ใจดี นาย นาง",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. İstanbul, Işık, Şahin, Çağlar, Özgür, Güneş, Yılmaz, Doğan, için, çok, değil, Öztürk, İzmir, Ayşe, Çelik, şehir, adı, Eskişehir, Muğla",
    "lt": "Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis. Jiems suteiktas protas ir sąžinė ir jie turi elgtis vienas kito atžvilgiu kaip broliai. Šiauliai, Čiurlionis, ąžuolas, ėjo, įmonė, ūkis, Žemaitė, kuris, šis, būti, Klaipėda, Panevėžys, Kęstutis",
    "lv": "Visi cilvēki piedzimst brīvi un vienlīdzīgi savā pašcieņā un tiesībās. Viņi ir apveltīti ar saprātu un sirdsapziņu, un viņiem jāizturas citam pret citu brālības garā. Rīga, Jānis, Bērziņš, Ķekava, Ģirts, Liepāja, Kalniņš, Ozoliņa, vārds",
    "et": "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus. Tõnu, Jüri, Pärnu, Öö, Õunapuu, Ülle, küla, Kärt",
    "ja": "すべての人間は、生れながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。東京都大阪府京都市北海道、田中太郎、山田花子、佐藤、鈴木、高橋、伊藤、渡辺、中村、小林、カタカナ、株式会社、名前、電話、住所、氏名、日本、会社、部長、ひらがなのなまえ",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。北京市，上海，广州，张伟，王芳，李娜，刘洋，姓名，电话，地址，公司，的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生自会那后能对着事其里所去行过家十用发天如然作方成者多日都三小军二无同么经法当起与好看学进种将还分此心前面又定见只主没公从陈杨黄赵吴周徐孙马朱胡林郭何高罗郑梁谢宋唐许",
    "tw": "人人生而自由，在尊嚴和權利上一律平等。他們賦有理性和良心，並應以兄弟關係的精神相對待。臺北市，高雄，陳志明，林淑芬，黃，張，李，王，姓名，電話，地址，公司，號碼，資料，的一是不了人我在有他這為之大來以個中上們到說國和地也子時道出而要於就下得可你年生自會那後能對著事其里所去行過家十用發天如然作方成者多日都三小軍二無同麼經法當起與好看學進種將還分此心前面又定見只主沒公從劉楊趙吳周徐孫馬朱胡郭何高羅鄭",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 서울특별시, 부산, 김철수, 이영희, 이름, 전화, 주소, 회사, 이다는의가을를에고하은로기지사도인리자시서어나아해정대수일제전그라만으보비스상장면구주신공원관동과성박최강조윤임오권황안송류홍민진현준",
}
_LATIN = ("fr", "de", "es", "pt", "it", "sv", "da")
SAMPLES["west"] = " ".join(SAMPLES[k] for k in _LATIN)  # names of several countries in one file
_LATIN += ("west",)
_CENTRAL = ("pl", "cs", "hu", "ro", "hr", "de")
#: Encodings of one byte a character: their languages, and how much less likely than others they are beforehand.
SINGLE = {
    "cp1252": (_LATIN, 0), "cp1250": (_CENTRAL, 1), "iso8859_2": (_CENTRAL, 2), "cp1251": (("ru", "uk", "bg"), 0), "koi8_r": (("ru",), 1), "koi8_u": (("uk",), 2), "iso8859_5": (("ru", "bg"), 3), "cp866": (("ru",), 2),
    "cp1253": (("el",), 1), "iso8859_7": (("el",), 2), "cp1254": (("tr",), 1), "cp1255": (("he",), 1), "cp1256": (("ar",), 1), "iso8859_6": (("ar",), 2), "cp1257": (("lt", "lv", "et"), 1), "tis_620": (("th",), 1), "iso8859_15": (_LATIN, 3), "mac_roman": (_LATIN, 4), "cp850": (_LATIN, 4),
}
#: Encodings of two bytes a character: the language, the codec to read with, and shares of its kinds of characters.
DOUBLE = {"shift_jis": ("ja", "cp932"), "euc_jp": ("ja", "euc_jp"), "gb18030": ("zh", "gb18030"), "big5": ("tw", "cp950"), "euc_kr": ("ko", "cp949")}
#: A mean log-likelihood of bytes below this says nothing (the first of one byte a character); a lead below this decides nothing.
LEAST, LEAST_DOUBLE, LEAD = -5.5, -6.5, 2.0
_RARE = math.log(1e-9)


def _kind(ch: str, spoken: frozenset[str]) -> str:
    """lower and upper letters of the language, other letters, marks of punctuation, signs, controls."""
    c = unicodedata.category(ch)
    if c in ("Lu", "Lt"):
        return "U" if ch in spoken else "o"
    if c[0] in "LM":
        return "L" if ch in spoken else "o"
    if ch in " \n\r\t\xa0" or c in ("Pd", "Ps", "Pe", "Pi", "Pf", "Nd", "Zs") or c == "Po" and (ch.isascii() or ch in "…·¿¡،؛؟"):
        return "P"
    return "C" if c[0] == "C" or "─" <= ch <= "▟" else "S"


#: How often a kind of character that is not ASCII stands after another kind.
_AFTER = {
    "L": {"L": 0.95, "U": 0.003, "P": 0.02, "o": 1e-3, "S": 1e-3, "C": 1e-6},
    "U": {"L": 0.7, "U": 0.25, "P": 0.02, "o": 1e-3, "S": 1e-3, "C": 1e-6},
    "P": {"L": 0.5, "U": 0.4, "P": 0.03, "o": 2e-3, "S": 5e-3, "C": 1e-6},
    "o": {"L": 0.05, "U": 0.02, "P": 0.02, "o": 0.05, "S": 5e-3, "C": 1e-6},
    "S": {"L": 0.1, "U": 0.1, "P": 0.05, "o": 2e-3, "S": 0.05, "C": 1e-6},
    "C": {"L": 0.05, "U": 0.05, "P": 0.02, "o": 2e-3, "S": 0.01, "C": 0.01},
}


@cache
def _language(name: str) -> tuple[frozenset[str], Counter, Counter]:
    """Letters, counts of characters and of pairs of a language's sample."""
    text = "\n" + unicodedata.normalize("NFC", SAMPLES[name]) + "\n"
    both = {x for ch in text if ch.isalpha() or unicodedata.category(ch)[0] == "M" for x in (ch, ch.lower(), ch.upper()) if len(x) == 1}
    return frozenset(both), Counter(text), Counter(zip(text, text[1:], strict=False))


@cache
def _pair_model(code: str, name: str) -> np.ndarray:
    """log P(second byte | first) for second bytes that are not ASCII, and what follows a byte that is not ASCII."""
    spoken, one, two = _language(name)
    chars = [bytes([b]).decode(code, "replace") for b in range(256)]
    bad = np.array([c == "�" for c in chars])
    kinds = [_kind(c, spoken) for c in chars]
    latin = name in _LATIN + _CENTRAL + ("tr", "lt", "lv", "et")
    foreign = [not latin and c.isascii() and c.isalpha() for c in chars]
    size = Counter(kinds[128:])
    total = {k: sum(one[c] + 0.3 for c, kk in zip(chars[128:], kinds[128:], strict=True) if kk == k) for k in size}
    within = [(one[c] + 0.3) / total[k] if b >= 128 else 0.0 for b, (c, k) in enumerate(zip(chars, kinds, strict=True))]
    out = np.zeros((256, 256))
    for a in range(256):
        kind = "o" if foreign[a] else kinds[a]
        before = sum(n for (x, _), n in two.items() if x == chars[a]) if not bad[a] else 0
        for b in range(128, 256):
            rule = _AFTER[kind][kinds[b]] * within[b]
            seen = two[chars[a], chars[b]] / (before + 3) if before else 0.0
            out[a, b] = _RARE if bad[b] else math.log(max(rule * (0.6 if before else 1.0) + 0.4 * seen, 1e-12))
        if a >= 128:
            for b in range(128):  # a letter of another script, or a capital, right behind
                if foreign[b]:
                    out[a, b] = -4.0 if kinds[a] in "LU" else 0.0
                elif kinds[a] == "U" and chars[b].islower() and latin or kinds[a] == "L" and not chars[b].isupper():
                    seen = two[chars[a], chars[b]]
                    out[a, b] = math.log(0.3 + seen) if chars[b].isalpha() else 0.0
                elif kinds[a] == "L" and chars[b].isupper():
                    out[a, b] = -4.0
                elif kinds[a] in "SC" and chars[b].isalpha():
                    out[a, b] = -1.0
    return out


@cache
def _char_model(name: str) -> np.ndarray:
    """log P of each character of the basic plane, per byte of two."""
    p = np.full(65536, 1e-9)

    def share(of: float, chars: list[str]) -> None:
        for c in chars:
            p[ord(c)] += of / len(chars)

    def rows(codec: str, first: int, last: int) -> list[str]:
        got = []
        for lead in range(first, last + 1):
            for trail in (*range(0x40, 0x7F), *range(0xA1, 0xFF)):
                try:
                    got.append(bytes([lead, trail]).decode(codec))
                except UnicodeDecodeError:
                    continue
        return [c for c in got if len(c) == 1]

    marks = list("、。，．・：；？！「」『』（）〔〕【】《》〈〉“”‘’…—～　·")
    share(0.03, marks)
    share(0.01, [chr(c) for c in range(0xFF01, 0xFF5F)])
    if name == "ja":
        share(0.45, [chr(c) for c in range(0x3041, 0x3094)])
        share(0.15, [chr(c) for c in range(0x30A1, 0x30FF)])
        share(0.004, [chr(c) for c in range(0xFF66, 0xFFA0)])
        share(0.35, rows("euc_jp", 0xB0, 0xCF))
        share(0.01, rows("euc_jp", 0xD0, 0xF4))
    elif name == "ko":
        share(0.95, rows("euc_kr", 0xB0, 0xC8))
        share(0.005, rows("euc_kr", 0xCA, 0xFD))
    else:
        codec, level = ("gb2312", (0xB0, 0xD7, 0xD8, 0xF7)) if name == "zh" else ("big5", (0xA4, 0xC6, 0xC9, 0xF9))
        share(0.9, rows(codec, *level[:2]))
        share(0.03, rows(codec, *level[2:]))
    sample = Counter(c for c in SAMPLES[name] if not c.isascii())
    total = sum(sample.values())
    p *= 0.6
    for c, n in sample.items():
        p[ord(c)] += 0.4 * n / total
    return np.log(p)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of bytes, and for each double-byte encoding its errors and likelihood: kind, key, n, value."""
    pairs = np.zeros(65536, np.int64)
    errors, likely = Counter(), Counter()
    for batch in batches:
        raw = batch.column(0).to_pylist()
        data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8).astype(np.int64)
        pairs += np.bincount(data[:-1] * 256 + data[1:], minlength=65536)
        for code, (name, codec) in DOUBLE.items():
            model = _char_model(name)
            for line in raw:
                try:
                    text = line.decode(codec)
                except UnicodeDecodeError:
                    errors[code] += 1
                    continue
                at = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                at = at[at >= 128]
                likely[code] += float(model[np.minimum(at, 65535)].sum())
    on = np.flatnonzero(pairs)
    codes = list(DOUBLE)
    kind = ["pair"] * len(on) + codes
    key = np.concatenate([on, np.zeros(len(codes), np.int64)])
    n = np.concatenate([pairs[on], [errors[c] for c in codes]])
    value = np.concatenate([np.zeros(len(on)), [likely[c] for c in codes]])
    yield pa.RecordBatch.from_pydict({"kind": pa.array(kind), "key": pa.array(key), "n": pa.array(n.astype(np.int64)), "value": pa.array(value.astype(np.float64))})


def decided(pairs: np.ndarray, double: dict[str, float]) -> str:
    """The encoding of bytes, from counts of their pairs and the likelihoods of double-byte encodings that fit all lines."""
    high = [b for b in range(128, 256) if pairs[:, b].any()]
    n = int(pairs[:, 128:].sum())
    scores: dict[str, float] = dict(double)
    said: dict[str, str] = {}
    for code, (names, less) in SINGLE.items():
        try:
            said[code] = bytes(high).decode(code)
        except UnicodeDecodeError:
            continue
        scores[code] = max(float((pairs * _pair_model(code, name)).sum()) for name in names) - less
    order = sorted(scores, key=scores.get, reverse=True)
    if not order or scores[order[0]] < (LEAST_DOUBLE if order[0] in DOUBLE else LEAST) * n:
        raise ParseError("the file's encoding is not known; name it")
    best = order[0]
    other = next((c for c in order[1:] if c not in said or best not in said or said[c] != said[best]), None)
    if other and scores[best] - scores[other] < LEAD:
        raise ParseError(f"the file's encoding is not certain ({best} or {other}); name it")
    return DOUBLE[best][1] if best in DOUBLE else best


def encoding_of(lines: DataFrame) -> str:
    """The encoding of lines (one column of bytes); an error that quotes nothing if none is likely enough."""
    wrong = lines.toDF("value").where(~F.is_valid_utf8(F.col("value").cast("string")))
    if wrong.isEmpty():
        return "utf-8"
    seen = wrong.mapInArrow(_counted, "kind string, key long, n long, value double").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect()  # 65,541 rows at most
    pairs = np.zeros((256, 256))
    double = {}
    for r in seen:
        if r.kind == "pair":
            pairs[r.key >> 8, r.key & 255] = r.n
        elif not r.n:
            double[r.kind] = r.value
    return decided(pairs, double)
