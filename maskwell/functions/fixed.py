"""Patterns, word lists, scores and masks that results depend on."""

# Fixed values of the document recognizers: (rule, entity, pattern, score).
DOCUMENT_PATTERNS = [
    ("phone_jp", "PHONE_NUMBER_JP", r"0\d{1,4}-\d{1,4}-\d{4}", 0.7),
    ("mobile_jp", "PHONE_NUMBER_JP", r"0[1-9]0-\d{4}-\d{4}", 0.8),
    ("zip_jp", "JP_ZIP_CODE", r"\d{3}-\d{4}", 0.6),
    ("age_sai", "JP_AGE", r"\d{1,3}歳", 0.8),
    ("age_sai_short", "JP_AGE", r"\d{1,3}才", 0.8),
    ("gender", "JP_GENDER", r"(?:男性|女性)", 0.7),
]
#: Strings of which every match of a document pattern has one.
NEEDED = {
    "phone_jp": ["-"], "mobile_jp": ["-"], "zip_jp": ["-"], "age_sai": ["歳"], "age_sai_short": ["才"], "gender": ["男性", "女性"],
}
CONTEXT_WORDS = {
    "PHONE_NUMBER_JP": ["TEL", "電話", "携帯", "自宅", "tel", "Tel", "電話番号"],
    "JP_ZIP_CODE": ["〒", "郵便番号", "郵便", "zip", "ZIP", "住所"],
    "JP_AGE": ["年齢", "生年月日", "（", "）", "歳"],
    "JP_GENDER": ["性別"],
}
BIRTH_DATE_PATTERNS = [
    r"\d{4}/\d{1,2}/\d{1,2}",
    r"\d{4}-\d{1,2}-\d{1,2}",
    r"\d{4}年\d{1,2}月\d{1,2}日",
    r"令和\d{1,2}年\d{1,2}月\d{1,2}日",
    r"平成\d{1,2}年\d{1,2}月\d{1,2}日",
    r"昭和\d{1,2}年\d{1,2}月\d{1,2}日",
]
BIRTH_WORDS = ["生年月日", "年齢", "生まれ", "誕生日", "生年"]
CAREER_WORDS = ["学歴", "職歴", "職務経歴", "入学", "卒業", "入社", "退社", "現在"]
ADDRESS_PATTERN = r"(?:東京都|北海道|(?:京都|大阪)府|[^\s]{2,3}県)[^\s\n]{3,30}"
ADDRESS_WORDS = ["住所", "〒", "現住所", "所在地"]
NOT_ADDRESS_SUFFIXES = [
    "高等学校", "高校", "中学校", "中学", "小学校", "小学", "大学", "大学院", "専門学校", "学園", "学院",
    "株式会社", "会社", "有限会社", "合同会社", "法人", "銀行", "病院", "クリニック", "事務所", "研究所",
    "センター", "協会", "組合", "財団", "社団",
]
NAME_WORDS = ["氏名", "ふりがな", "フリガナ", "名前"]
NAME_PATTERNS = [
    r"氏名[:\s　]*([一-龯ぁ-んァ-ン]{1,5}[\s　]?[一-龯ぁ-んァ-ン]{1,5})",
    r"ふりがな[:\s　]*([ぁ-ん]{1,10}[\s　]?[ぁ-ん]{1,10})",
    r"フリガナ[:\s　]*([ァ-ン]{1,10}[\s　]?[ァ-ン]{1,10})",
    r"名前[:\s　]*([一-龯ぁ-んァ-ン]{1,5}[\s　]?[一-龯ぁ-んァ-ン]{1,5})",
]

# Fixed values of the line candidates.
EMAIL_ASCII = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
EMAIL = EMAIL_ASCII + r"|[぀-ゟ゠-ヿ一-鿿\w._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_JP = [r"0\d{1,4}-\d{1,4}-\d{4}", r"0\d{9,10}", r"\+81-?\d{1,4}-?\d{1,4}-?\d{4}"]
PHONE_EN = [r"\+1-?\d{3}-?\d{3}-?\d{4}", r"\(\d{3}\)\s?\d{3}-\d{4}"]
ZIP_JP = r"〒?\s*\d{3}-\d{4}"
ZIP_US = r"\b\d{5}(?:-\d{4})?\b"
DATES = [r"\b\d{4}-\d{2}-\d{2}\b", r"\d{4}年\d{1,2}月\d{1,2}日", r"\b\d{4}/\d{1,2}/\d{1,2}\b"]
BIRTH_LINE_WORDS = ["birth", "生年月日", "誕生", "生まれ", "date of birth"]
AGE = r"(\d{1,3})\s*歳"
GENDER = r"[（(]?\s*(男性?|女性?|男|女)\s*[）)]?"
PREFECTURES = [
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県", "栃木県", "群馬県", "埼玉県",
    "千葉県", "東京都", "神奈川県", "新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県",
    "愛知県", "三重県", "滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県", "鳥取県", "島根県", "岡山県",
    "広島県", "山口県", "徳島県", "香川県", "愛媛県", "高知県", "福岡県", "佐賀県", "長崎県", "熊本県", "大分県",
    "宮崎県", "鹿児島県", "沖縄県",
]
ADDRESS_ENDS = ["\n", "　", "  ", "Email", "email", "Phone", "phone", "TEL", "tel"]

# Fixed values of sections, verification and masking.
SECTION_HEADINGS = {
    "contact": (["連絡先", "住所", "基本情報", "個人情報"], ["Contact", "Personal", "Personal Information"]),
    "education": (["学歴"], ["Education", "Academic", "EDUCATION"]),
    "experience": (
        ["職歴", "職務経歴", "経歴", "職務経歴書サマリー"],
        ["Experience", "Work Experience", "Employment", "WORK EXPERIENCE", "PROFESSIONAL SUMMARY"],
    ),
    "skills": (["スキル", "技術", "技術スキル"], ["Skills", "Technical Skills", "TECHNICAL SKILLS"]),
    "certifications": (["資格", "認定"], ["Certifications", "Licenses", "CERTIFICATIONS"]),
}
ENTITY_PRIORITY = [
    "EMAIL_ADDRESS", "PHONE_NUMBER_JP", "PHONE_NUMBER", "JP_ZIP_CODE", "US_ZIP_CODE", "CUSTOMER_ID_JP", "JP_ADDRESS",
    "LOCATION", "JP_ORGANIZATION", "JP_PERSON", "PERSON", "DATE_OF_BIRTH_JP", "DATE", "JP_AGE", "JP_GENDER",
]
MASK_FROM, REVIEW_FROM = 0.7, 0.5
SECTION_POLICY = {"education": (-0.3, -0.2), "experience": (-0.3, -0.2), "contact": (0.2, 0.2)}
PERSON_TYPES, ADDRESS_TYPES = ["JP_PERSON", "PERSON"], ["JP_ADDRESS", "LOCATION"]
VALID_FORMATS = {
    "EMAIL_ADDRESS": ("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$|^[぀-ゟ゠-ヿ一-鿿\w._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
    "PHONE_NUMBER_JP": ("phone_jp", r"^0\d{1,4}-?\d{1,4}-?\d{4}$|^\+81-?\d{1,4}-?\d{1,4}-?\d{4}$"),
    "PHONE_NUMBER": ("phone_en", r"^\+1-?\d{3}-?\d{3}-?\d{4}$|^\(\d{3}\)\s?\d{3}-\d{4}$"),
    "JP_ZIP_CODE": ("jp_zip", r"^〒?\s*\d{3}-\d{4}$"),
    "US_ZIP_CODE": ("us_zip", r"^\d{5}(-\d{4})?$"),
}
DATE_FORMATS = [r"^(\d{4})-(\d{2})-(\d{2})", r"^(\d{4})年(\d{1,2})月(\d{1,2})日", r"^(\d{4})/(\d{1,2})/(\d{1,2})"]
DEFAULT_MASK = "****"
MASKS = {
    "DATE_OF_BIRTH_JP": "****/**/**",
    "JP_ADDRESS": "****",
    "JP_PERSON": "****",
    "JP_ORGANIZATION": "****",
    "JP_ZIP_CODE": "***-****",
    "PHONE_NUMBER_JP": "***-****-****",
    "CUSTOMER_ID_JP": "****",
}

# Fixed values of model seams: context words and scores of pipeline entities, tags of
# generated text and the longest span of an entity, categories of equivalent types.
NER_WINDOW, NER_NEAR, NER_ALONE = 50, 0.9, 0.6
NER_PERSON_WORDS = ["氏名", "ふりがな", "フリガナ", "名前", "お名前", "姓名"]
NER_ADDRESS_WORDS = ["住所", "現住所", "連絡先", "都道府県", "市区町村", "番地", "所在地"]
NER_CANDIDATE_LABELS = {"PERSON": "JP_PERSON", "LOC": "JP_ADDRESS", "GPE": "JP_ADDRESS", "ORG": "JP_ORGANIZATION"}
GENERATED_TAGS = {
    "<name>": "JP_PERSON", "<birthday>": "DATE_OF_BIRTH_JP", "<phone-number>": "PHONE_NUMBER_JP", "<mail-address>": "EMAIL_ADDRESS",
    "<customer-id>": "CUSTOMER_ID_JP", "<address>": "JP_ADDRESS", "<post-code>": "JP_ZIP_CODE", "<company>": "JP_ORGANIZATION",
}
LONGEST_GENERATED = {
    "JP_ADDRESS": 200, "JP_PERSON": 40, "JP_ORGANIZATION": 80, "CUSTOMER_ID_JP": 40, "EMAIL_ADDRESS": 80, "PHONE_NUMBER_JP": 40,
    "JP_ZIP_CODE": 20, "DATE_OF_BIRTH_JP": 30,
}
CATEGORIES = {
    "location": ["LOCATION", "JP_ADDRESS", "LOC", "GPE"], "organization": ["ORGANIZATION", "JP_ORGANIZATION", "ORG"],
    "person": ["PERSON", "JP_PERSON", "PER"], "identifier": ["CUSTOMER_ID_JP"],
}
REQUIRED_TYPES = {
    "名前": ["PERSON", "JP_PERSON"], "Email": ["EMAIL_ADDRESS"], "住所": ["JP_ADDRESS", "ADDRESS", "LOCATION"],
    "生年月日": ["DATE_OF_BIRTH_JP", "DATE_OF_BIRTH", "DATE"], "郵便番号": ["JP_ZIP_CODE", "ZIP_CODE"], "電話番号": ["PHONE_NUMBER_JP", "PHONE_NUMBER"],
}
