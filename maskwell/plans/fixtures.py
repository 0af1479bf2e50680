"""Small inputs of our own, in Japanese and English, that the registered queries add to the driver's tables."""

from __future__ import annotations

FIXTURE = [
    (-1, "基本情報\n氏名 山田 太郎\n生年月日 1990年5月15日 (32歳) 男性\n住所 〒150-0001 東京都渋谷区神宮前一丁目\n電話 090-1234-5678\nmail taro@example.com"),
    (-2, "学歴\n1990/4/1 入学 東京都立中央高等学校\n職歴\n2010-04-01 入社  大阪府大阪市北区梅田三丁目\nスキル\nTEL 03-1234-5678"),
    (-3, "  Contact:  x　y\n\n\n\nTEL +1-555-123-4567 or (555) 123-4567, 12345-6789\nEducation\nBirth 1985-02-30 a.b@c.org,d@e.net\nSkills\n女性 45才"),
    (-4, ""),
    (-6, "履歴書\n\n氏名: 佐藤花子\nふりがな: さとうはなこ\n\n生年月日: 1988/03/05 (36歳)\n性別: 女性\n現住所:\n〒530-0001\n大阪府大阪市北区梅田1-2-3\n連絡先:\nTEL: 06-6123-4567\n携帯: 080-1111-2222\nEmail: hanako.sato@example.co.jp\n学歴:\n2007年4月1日 大阪大学 入学\n2011年3月31日 大阪大学 卒業\n職歴:\n2011年4月1日 株式会社テスト 入社\n北海道札幌市中央区第一高校 勤務\n以上"),
    (-7, "生年月日: 令和5年12月1日\n誕生日 平成2年1月1日\n年齢: 昭和45年3月3日 現在55歳\n名前 鈴木 一郎 フリガナ スズキ イチロウ\n神奈川県横浜市西区みなとみらい2-2-1 所在地\n社員番号 EMP12345 と EMP67890"),
    (-8, "John Smith\nContact: (415) 555-0199, john.smith+cv@mail.example.org\nPhone: +14155550123\nZIP 94103-1234 and 94107 or 19991\nDate of Birth: 1985-02-28\nWork Experience\n2010-01-01 - 2015-12-31 Example Corp, 10001\nSupport at (212) 555-0147 and help@example.com"),
    (-9, "年齢 150歳 と 99 歳、男 （女性） 男性\nTEL+81-3-1234-5678 0312345678 〒 100-0005 12100-0006 1-100-0007\nPhone 0120-123-4567 / 2020年13月1日 2020/12/31"),
    (-10, "連絡先 東京都府中市1-2-3 電話0120-123-4567 x@y.co\n住所 北海道釧路市黒金町7 tel 0154-11-2222\n会社所在地 愛知県名古屋市中村区名駅株式会社\n氏名　田中　次郎　ふりがな　たなか　じろう\n生年月日　2001年2月31日　２３歳　性別　男性"),
    (-11, "職歴 2015年4月1日 入社 生年月日 1991年1月2日 学歴 年齢 1992年3月4日 卒業\n生まれ 1993/5/6 入学 1994/7/8"),
]

#: Entities as a language pipeline would supply them: (doc_id, label, text); offsets follow from the text.
PIPELINE_ENTITIES = [(-6, "PERSON", "佐藤花子"), (-6, "LOC", "大阪府大阪市北区"), (-6, "ORG", "株式会社テスト"), (-8, "PERSON", "John Smith"), (-7, "PERSON", "鈴木 一郎"), (-10, "LOC", "名古屋市")]

#: Classified tokens with offsets: (id, text, [(label, score, start, end)]).
TOKENS = [
    (1, "Ann Lee x. Paris", [("O", 0.9, 0, 0), ("B-PER", 0.75, 0, 3), ("I-PER", 0.5, 4, 7), ("I-LOC", 0.9, 8, 9), ("O", 0.9, 9, 10), ("LOC", 0.5, 11, 16)]),
    (2, "山田太郎は東京都", [("人名", 0.5, 0, 2), ("人名", 1.0, 2, 4), ("O", 1.0, 4, 5), ("地名", 0.25, 5, 8)]),
    (3, "B B", [("B-PER", 0.5, 0, 1), ("B-PER", 0.75, 2, 3), ("B-X", 1.0, 2, 3)]),
    (4, "", []),
]
TOKEN_LABELS = {"B-PER": "PERSON", "I-PER": "PERSON", "I-LOC": "LOCATION", "LOC": "LOCATION", "人名": "JP_PERSON", "地名": "JP_ADDRESS"}

#: Classified tokens without offsets: (id, text, [(label, score, word)]), marks at both ends.
WORDS = [
    (1, "Ann Lee met Ann Lee in Paris", [("O", 1.0, "[CLS]"), ("B-PER", 0.5, "Ann"), ("I-PER", 1.0, "Lee"), ("O", 1.0, "met"), ("B-PER", 0.5, "Ann"), ("LOC", 0.75, "Par"), ("LOC", 0.25, "##is"), ("O", 1.0, "[SEP]")]),
    (2, "山田太郎です", [("O", 1.0, "[CLS]"), ("人名", 0.5, "山田"), ("人名", 0.5, "太郎"), ("O", 1.0, "です"), ("O", 1.0, "[SEP]")]),
    (3, "nothing", [("O", 1.0, "[CLS]"), ("LOC", 0.5, "Rome"), ("O", 1.0, "[SEP]")]),
]

#: Texts and what a generator made of them: (id, text, generated).
GENERATED = [
    (1, "受付：お名前は山田太郎ですか？会員IDはABC12345です。東京都練馬区在住です。", "受付:お名前は<name>ですか?会員IDは<customer-id>です。<address>在住です。"),
    (2, "会員IDはABC12345です。", "会員IDは<customer-id>"),
    (3, "担当の鈴木様へ連絡して下さい、よろしく。", "担当の<name>様え連絡して下さい、よろしく。"),
    (4, "前書き" + "長" * 50 + "終わりです。", "前書き<name>終わりです。"),
    (5, "a\nmail x@y.co end of it", "a<LB>mail <mail-address><name> end of it"),
    (6, None, "<name>"),
]

#: Lines of an allow-list dictionary.
DICTIONARY = ["Python", "Amazon Web Services/alias[AWS|Amazon WS]", "", "C++/js[cpp]", "AWS", "  PostgreSQL  /alias[Postgres||pg]", "help@example.com"]

#: What should be found: (doc_id, text).
EXPECTED = [(-6, "佐藤花子"), (-6, "530-0001"), (-6, "1988/03/05"), (-6, "hanako.sato@example.co.jp"), (-6, "東京都"), (-7, "鈴木 一郎"), (-7, "EMP12345"), (-8, "john.smith+cv@mail.example.org"), (-8, "94107")]

#: Resumes: (id, language, job title, technologies, certifications, name, email, university, degree, year, company, position, from, to).
RESUMES = [
    ("R1", "English", "Data Engineer", ["Spark", "SQL", "Airflow", "Python"], ["Cloud Architect"], "Ann Lee", "ann@example.com", "Riverside College", "BSc", 2014, "Acme", "Engineer", 2014, None),
    ("R2", "English", "Web Developer", ["TypeScript", "SQL", "HTML"], [], "Bo Kim", "bo@example.org", "North University", "MSc", 2016, "Widgets", "Developer", 2016, 2020),
    ("R3", "Japanese", "データエンジニア", ["Spark", "Python", "SQL"], ["基本情報"], "山本 花", "hana@example.jp", "東大学", "学士", 2018, "株式会社例", "技術者", 2018, None),
    ("R4", "Japanese", "データエンジニア", ["Python", "Go"], ["応用情報", "英検"], "伊藤 健", "ken@example.jp", "西大学", "修士", 2012, "有限会社例", "主任", 2012, 2022),
    ("R5", "English", "Data Engineer", [], [], "Cy Doe", "cy@example.com", "East Tech", "BSc", 2020, "Initech", "Analyst", 2020, None),
    ("R6", "English", "Analyst", ["R", "SQL", "Excel", "Python", "Tableau", "SAS", "Julia", "Scala", "Rust"], ["A", "B"], "Di Roe", "di@example.com", "South Tech", "BA", 2011, "Hooli", "Analyst", 2011, 2013),
]
