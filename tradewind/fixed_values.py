"""Fixed values.

Every literal below must equal the value the business data was produced with:
labels, phrases, captions, word lists, regular expressions and thresholds.
They are defaults; each operator takes them as parameters. Patterns are written
in the regex subset shared by Java and Python and are compiled with Java's
Unicode character classes (see ``functions.text.rx``).
"""

from __future__ import annotations

# --- labels --------------------------------------------------------------
UNKNOWN_STORE = "(უცნობი მაღაზია)"
UNKNOWN_BUYER = "(უცნობი მყიდველი)"
MISSING_ADDRESS = "მისამართი ბაზაში არაა"
UNKNOWN_LOCATION = "ლოკაცია დაუზუსტებელია"
OTHER_STORES = "სხვა მაღაზიები"
DEFAULT_UNIT = "ცალი"
DEFAULT_CURRENCY = "GEL"
WAYBILL_SOURCE_FILE = "rs_ge_sync"

# --- display ---------------------------------------------------------------
ADDRESS_SNIPPET = 28

# --- period presets (label -> inclusive days) ----------------------------
PRESET_DAYS = {
    "7 Days": 7,
    "7 დღე": 7,
    "15 Days": 15,
    "15 დღე": 15,
    "1 Month": 30,
    "1 თვე": 30,
    "6 Months": 183,
    "6 თვე": 183,
    "1 Year": 365,
    "1 წელი": 365,
}
DEFAULT_PRESET_DAYS = 30

# --- return / credit documents -------------------------------------------
RETURN_PHRASES = (
    r"საკრედიტო|დაბრუნება|უკან\s+დაბრუნება|ჩაბარება|კორექტირება|"
    r"(?<![A-Za-z])Return(?![A-Za-z])|(?<![A-Za-z])Credit(?![A-Za-z])"
)
CREDIT_NUMBER_PREFIX = r"^\s*(?:CR|RET)\b"
RETURN_RAW_TEXT = r"უკან\s*დაბრუნება|საკრედიტო|კორექტირება"
CREDIT_WORD = "საკრედიტო"
ORDER_NOTE_EXCLUSIONS = ("უკან დაბრუნება", "საკრედიტო", "კორექტირება")
ORDER_NUMBER_EXCLUSIONS = ("უკან", "credit")
RETURN_NOTE_PHRASE = "უკან დაბრუნება"
RETURN_NOTE_WORD = "უკან"

# --- supplier head office ------------------------------------------------
SUPPLIER_HQ_FORMS = (
    "თბილისი,თ.ერისთავის 1",
    "თბილისი, თ.ერისთავის_1",
    "თბილისი,თ.ერისთავის_1",
    "თბილისი, თ.ერისთავის 1",
)
SUPPLIER_HQ_PATTERN = r"(?:^|\s*,\s*)თბილისი\s*,\s*თ\.\s*ერისთავის[_\s]*1\s*,?\s*"
HQ_DOCUMENT_FRAGMENTS = ("თ.ერისთავის", "ერისთავის_1", "200249043")
HQ_STORE_FRAGMENTS = ("თ.ერისთავის", "ერისთავის 1", "ერისთავის_1")

# --- store names and addresses -------------------------------------------
BRANCH_CODE = r"#\s*(\d+)"
STORE_NAME_TYPOS = (
    ("წიკორა", "ნიკორა"),
    ("0რი ნაბიჯი", "ორი ნაბიჯი"),
    ("Oრი ნაბიჯი", "ორი ნაბიჯი"),
    ("oრი ნაბიჯი", "ორი ნაბიჯი"),
)
STORE_KEYWORDS = (
    "ნიკორა",
    "ორი ნაბიჯი",
    "ზღაპარი",
    "ლაქი",
    "სმარტ",
    "გვირილა",
    "რითეილ",
    "მოტორს",
    "მ.ა.მ",
)
NAME_ROW_NUMBER = r"^#?\s*\d{1,3}[.)\s]+"
NAME_SPACED_LEGAL_FORM = r"შ\s*პ\s*ს"
NAME_INLINE_ID = r"(?:საიდენტიფიკაციო|პირადი\s*ნომერი)\s*[:]?\s*\d{5,15}"
NAME_TRAILING_ID = r"(?:\s+|[,;|])+(\d{9,12})(?:\s*$)"
NAME_LEADING_ID = r"^(\d{9,12})(?:\s+|\s*[,;|-]\s*)"
NAME_SELLER_NOISE = r"შპს\s*ელთი\s*დისტრიბუცია|ელთი\s*დისტრიბუცია|200249043"
NAME_TRAILING_PAREN = r"\s*\([^)]{1,30}\)\s*$"
NAME_STRIP_CHARS = " ,;|-"
STORE_NAME_FIXES = (
    (r"(?:შპს\s+)?ორი\s+წაბიჯის", "შპს ორი ნაბიჯის"),
    (r"(?:შპს\s+)?ორი\s+წაბიჯი", "შპს ორი ნაბიჯი"),
    (r"შპსშპს", "შპს"),
    (r"შპს\s{2,}", "შპს "),
    (r"შპს(?=[\u10D0-\u10FF])", "შპს "),
    (r"სს(?=[\u10D0-\u10FF])", "სს "),
    (r"(?<=\d)ო(?=\d)", "0"),
    (r"(?<=\d)ო(?=\s|$)", "0"),
    (r"(?<![\u10D0-\u10FF])ო(?=\d)", "0"),
    (r"\bწპს\b", "შპს"),
    (r"\bშპწ\b", "შპს"),
    (r"\bშპნ\b", "შპს"),
    (r"([ა-ჰ])\1{2,}", "$1$1"),
)
ADDRESS_FIXES = (
    (r"ნინუბანი", "წინუბანი"),
    (r"ნენუბანი", "წინუბანი"),
    (r"წინბანი", "წინუბანი"),
    (r"წინუბნი", "წინუბანი"),
    (r"დიდი\s+ნილო", "დიდი ლილო"),
    (r"დიდი\s+ნინო", "დიდი ლილო"),
    (r"დიდი\s+ლინო", "დიდი ლილო"),
    (r"გელდანი", "გლდანი"),
    (r"გლდნი", "გლდანი"),
    (r"გზდანი", "გლდანი"),
    (r"ვარკეტილი", "ვარკეთილი"),
    (r"ვარკთილი", "ვარკეთილი"),
    (r"ვარკეთილში", "ვარკეთილი"),
    (r"\bისნი\b", "ისანი"),
    (r"სამგორში", "სამგორი"),
    (r"სამგორს", "სამგორი"),
    (r"ნუცბიძე", "ნუცუბიძე"),
    (r"ნუცუბიჯე", "ნუცუბიძე"),
    (r"ნუცუბიძის\s+გამზ", "ნუცუბიძის გამზ"),
)
FUZZY_THRESHOLD = 0.9
TOKEN_WEIGHT = 0.9

# --- products ------------------------------------------------------------
SHELF_LIFE_DAYS = (("შავი", 7), ("რუხი", 7), ("dark", 7))
SHELF_LIFE_DEFAULT = 6
# (priority, canonical name, part 1, part 2, part 3): all parts must occur.
MERGE_RULES = (
    (102, "ფრანგული ტოსტის პური", "ფრანგული ტოსტის", None, None),
    (102, "ფრანგული ტოსტის პური", "ფრანგული", "ტოსტის პური", None),
    (101, "ფრანგული ტოსტის პური", "ფრანგულ", "ტოსტის", None),
    (101, "ფრანგული ტოსტის პური", "ფრანგული", "ტოსტს პური", None),
    (100, "სენდვიჩ ტოსტი (470გრ პური)", "სენდვიჩ ტოსტი", None, None),
    (100, "სენდვიჩ ტოსტი (470გრ პური)", "სეწდვიჩ ტოსტი", None, None),
    (100, "სენდვიჩ ტოსტი (470გრ პური)", "სენდვინ ტოსტი", None, None),
    (95, "პრემიუმ კლასი (პური მზესუმზირით 400გრ)", "პრემიუმკლასი", "მზესუმზირით", None),
    (95, "პრემიუმ კლასი (პური მზესუმზირით 400გრ)", "პრემიუმკლასი", "მხესუმზირით", None),
    (95, "პრემიუმ კლასი (პური მზესუმზირით 400გრ)", "პრემიუმკლასი", "მდესუმზირით", None),
    (94, "პრემიუმ კლასი (პური მზესუმზირით 400გრ)", "პრემიუმ კლასი", "მზესუმზირით", None),
    (94, "პრემიუმ კლასი (პური მზესუმზირით 400გრ)", "პრემიუმ კლასი", "მხესუმზირით", None),
    (94, "პრემიუმ კლასი (პური მზესუმზირით 400გრ)", "პრემიუმ კლასი", "მდესუმზირით", None),
    (93, "პრემიუმ კლასი (პური მზესუმზირით 400გრ)", "პრემიუმ კლასი", "მზესუმზირით", "47ო"),
    (93, "პრემიუმ კლასი (პური მზესუმზირით 400გრ)", "პრემიუმ", "მზესუმზირით", "400"),
    (90, "კულიჩი (470გრ)", "კულიჩი", "470", None),
    (90, "კულიჩი (470გრ)", "კულიჩ", "470", None),
    (90, "კულიჩი (470გრ)", "კულიჩი", "47ო", None),
    (90, "ჰამბურგერის პურები 320 გრ", "ჰამბურგერის", "320", None),
    (88, "400 გრ დიეტა, ქატოს პური", "დიეტა", "ქატოს", None),
)
LABEL_REPLACEMENTS = (("|", " "), ("47036", "470"))

# --- report thresholds ---------------------------------------------------
RISK_LOW_MAX = 10.0
RISK_MEDIUM_MAX = 22.0
RISK_LABELS = ("low", "medium", "high")
HEAT_RED_ABOVE = 30.0
HEAT_GREEN_BELOW = 10.0
RESTOCK_COVER = 1.75
CONFIDENCE_BASE = 70
CONFIDENCE_SPAN = 11
VISIT_DEFAULT_DAYS = 2.0
ORDER_BUFFER = 1.1
VISIT_CONFIDENCE = ((15, 85), (8, 75), (4, 65))
VISIT_CONFIDENCE_DEFAULT = 50
CV_STEADY = 0.3
CV_ERRATIC = 0.7
CONFIDENCE_HIGH = 80
CONFIDENCE_MEDIUM = 65
CACHE_WRITE_USD_PER_MILLION = 1.00

# --- waybill document captions and patterns ------------------------------
STEM_INVOICE = r"(?i)^invoice_\d"
WAYBILL_PATTERNS = (
    r"(?:^|\n)(\d{8,14}(?:/\d+)?)\s+სასაქონლო\s+ზედნადებ",
    r"(?i)ელ[-\s]*([0-9]{6,}\s*/\s*[0-9]+|[0-9]{8,})",
    r"(?i)(?:სასაქონლო\s*)?ზედნადები\s*#?\s*[:]?\s*(?:ელ[-\s]*)?([A-Za-z0-9\-\/\.]+)",
    r"(?i)(?:ზედნადები|ზედნადების\s*№|Waybill)\s*[:#]?\s*([A-Za-z0-9\-\/\.]+)",
    r"(?:№|#|No\.?)\s*[:#]?\s*([A-Z]{1,3}[\-/]?\d{4,})",
)
WAYBILL_LEADING_DIGITS = r"^(\d{8,14}(?:/\d+)?)\s+"
WAYBILL_LEADING_WORDS = r"დანართი|ზედნადებ|სასაქონლო"
WAYBILL_LEADING_HEAD = 500
WAYBILL_LEADING_WINDOW = 220
WAYBILL_KEY_MIN = 6
WAYBILL_BASE_MIN = 8
DATE_UNDER_LABEL = r"თარიღი\s*(?:\([^)]*\))?\s*[:#]?\s*(\d{1,2}[\/\.\-]\d{1,2}[\/\.\-]\d{2,4})"
DATE_ISO = r"\b(20\d{2}-\d{2}-\d{2})\b"
DATE_DMY = r"\b(\d{1,2}[\/\.\-]\d{1,2}[\/\.\-]\d{2,4})\b"
TIME_UNDER_LABEL = r"დრო\s*(?:\([^)]*\))?\s*[:#]?\s*((?:[01]?\d|2[0-3]):[0-5]\d:[0-5]\d)"
TIME_OF_DAY = r"\b((?:[01]?\d|2[0-3]):[0-5]\d:[0-5]\d)\b"
TIME_BEFORE_DATE = 160
TIME_AFTER_DATE = 520
ITEM_TABLE_CAPTION = r"სასაქონლო\s*ზედნადების\s*ცხრილი"
BUYER_LABEL = r"(?i)მყიდველის\s*\([^)]*მიმღების[^)]*\)\s*დასახელება"
BUYER_LABEL_WORDS = ("მყიდველის", "მიმღების", "დასახელება")
BUYER_LINES_ABOVE = 30
BUYER_WINDOW = (-8, 11)
BUYER_WINDOW_MIN_SCORE = 0.25
BUYER_HEADER_MIN_SCORE = 0.4
HEADER_BAND_LINES = 55
HEADER_GRID_ROW = r"\|\s*\d"
HEADER_GRID_ROW_MIN = 18
HEADER_GRID_FROM = 8
DIGITS_ONLY_LINE = r"^[\d\s/\-]+$"
LEGAL_FORM_LTD = "შპს"
LEGAL_FORM_JSC = "სს"
LEGAL_FORM_JSC_TOKEN = r"(^|\s)სს\s"
SELLER_ID_THEN_BUYER = r"(?s)(?<![0-9])\d{9}(?![0-9])\s+((?:შპს|სს)\s.*)$"
SELLER_NAME_WORDS = ("ელთი", "დისტრიბუცია")
SELLER_TAX_ID = "200249043"
SELLER_CAPTION = r"გამყიდველის\s*\("
RECEIVER_WORD = "მიმღების"
HEADER_JUNK = r"(?i)(სასაქონლო\s*ზედნადები|ზედნადები\s*#|ელ[-\s]*\d{5,})"
NAME_JUNK_LINE = (
    r"(?i)(^|\s)(გვარი|სახელი|წომერი|ღომერი|ნომერი|მიმღები|"
    r"ან\s+სახელი\s+და\s+გვარი|და\s+გვარი|საიდენტიფიკაციო|პირადი\s*ნომერი)($|\s)"
)
NAME_JUNK_FOOTER = r"გვარი\s+წომერი|გვარი\s+და\s+სახელი"
COLUMN_HEADER_WORDS = ("გვარი", "ნომერი")
COLUMN_HEADER_PAIR = r"გვარი.*ნომერი|ნომერი.*გვარი"
COLUMN_HEADER_MAX = 90
LEGAL_FORM_WORDS = ("შპს", "სს ")
NOT_A_NAME_WORDS = ("ოპერაციის", "ტრანსპორტირების")
NOT_A_NAME_CITY = r"თბილისი\s*,|ბათუმი\s*,|ქუთაისი\s*,"
NOT_A_NAME_AMOUNT = r"თანხა|ლარებში|თეთრი"
NOT_A_NAME_NUMBER = r"^\d[\d\s,/\-]*$"
NAME_MIN_LETTERS = 12
SCORE_LEGAL_FORMS = ("შპს", "სს ", "სს\t", "სს\n")
SCORE_LONG_WORD = r"[ა-ჰ]{6,}"
SCORE_LABEL_WORDS = ("დასახელება", "მყიდველ")
SCORE_POINTS = {
    "legal_form": 4.0,
    "long_word": 2.0,
    "negative_hint": -6.0,
    "only_digits": -8.0,
    "label": -5.0,
    "header_junk": -10.0,
}
SCORE_LENGTH = 80
ITEM_TABLE_WORDS = ("სასაქონლო", "ზედნადების", "ცხრილ")
NAME_NEGATIVE_HINTS = (
    "გამყიდველ",
    "გამგზავნ",
    "საიდენტიფიკაციო",
    "პირადი ნომერი",
    "ზედნადები",
    "თარიღი",
    "დრო",
)
ID_LABEL = r"(?i)საიდენტიფიკაციო\s*/\s*პირადი\s*ნომერი|საიდენტიფიკაციო\s*/\s*პირადი"
ID_LABEL_WORDS = ("საიდენტიფიკაციო", "პირადი", "/")
ID_LABEL_LINES_BELOW = 39
COMPLETION_CAPTION = (
    r"დასრუ*ლების\s*.{0,44}?ადგილ(?:ი|ის|ში|ზე)?(?:\s*\([^)]{0,40}\))?"
)
COMPLETION_CAPTION_TRANSPORT = (
    r"ტრანსპორტირების\s*.{0,56}?დასრუ*ლების\s*.{0,44}?ადგილ(?:ი|ის|ში|ზე)?"
    r"(?:\s*\([^)]{0,40}\))?"
)
CAPTION_TAIL = r"\s*[:\-–—]?\s*(.+)$"
COMPLETION_WORD = "დასრულების"
START_CAPTION_WORDS = ("დაწყების", "ადგილი")
ORIGIN_CAPTION = r"ტრანსპორტირების\s*დაწყების\s*ადგილ"
TRANSPORT_KIND = r"ტრანსპორტირების\s*სახე"
OPERATION_PREFIX = r"^ოპერაციის\b"
OPERATION_LABEL = r"^ოპერაციის\s+"
CONTENT_WORD = "შინაარსი"
SHORT_NUMBER_LINE = r"^[\d\s/\-]{6,24}$"
ID_NUMBER_LINE = r"^[\d\s]{6,15}$"
ORIGIN_NUMBER_LINE = r"^[\d\s/\-|]+$"
ORIGIN_LABEL_LINE = r"დასახელება|საიდენტიფიკაციო|გამყიდველ|ოპერაციის\s*შინაარს"
HASH_CODE = r"#\s*\d+"
ITEM_SECTION_WORD = "სასაქონლო"
BUYER_WORD = "მყიდველის"
FULL_TEXT_WINDOW = 1_200
BUYER_OFFSET_SLACK = 80
BUYER_BLOCK_PATTERNS = (
    r"მყიდველის\s*(?:\([^)]*\))?\s*დასახელება[^\n]*\n([\s\S]*?)"
    r"(?=ტრანსპორტირების\s*დაწყების|ოპერაციის\s*შინაარსი|სასაქონლო\s*ზედნადების\s*ცხრილი|"
    r"მიწოდებული\s*საქონლის)",
    r"ჩამბარებ(?:ელი|ლის)[^\n]*\n([\s\S]*?)(?=ტრანსპორტირების|ოპერაციის|სასაქონლო)",
)
CITY_TOKENS = (
    "თბილისი",
    "ქ.თბილისი",
    "ბათუმი",
    "ქუთაისი",
    "რუსთავი",
    "ზუგდიდი",
    "ფოთი",
    "გორი",
    "სამტრედია",
    "ხაშური",
    "მცხეთა",
    "ჭიათურა",
    "ზესტაფონი",
    "სენაკი",
    "მარნეული",
    "თელავი",
    "Tbilisi",
    "Batumi",
    "Kutaisi",
    "Rustavi",
    "Zugdidi",
    "Poti",
    "Gori",
)
STREET_HINTS = (
    "ქ.",
    "ქუჩა",
    "გამზირი",
    "გზატკეცილი",
    "ხეივანი",
    "მიკრორაიონი",
    "გზა",
    "მოპირდ",
    "სოფელი",
    "ერისთავის",
)
ADDRESS_START = (
    r"(?i)(?:თბილისი|ქ\.თბილისი|ბათუმი|ქუთაისი|რუსთავი|ზუგდიდი|ფოთი|გორი|"
    r"სამტრედია|ხაშური|მცხეთა|ჭიათურა|ზესტაფონი|სენაკი|მარნეული|თელავი|"
    r"Tbilisi|Batumi|Kutaisi|Rustavi|Zugdidi|Poti|Gori|"
    r"სოფელი|სოფ\.|"
    r"ქ\.\s*(?:თბილისი|[\u10a0-\u10ff]{2,})|ქუჩა|გამზირი|გზატკეცილი)"
)
ADDRESS_ADMIN_PREFIX = r"^(?:ოპერაციის|ტიპი|მიზანი|ტრანსპორტირების)"
ADDRESS_START_HINTS = ("ქ.", "ქუჩა", "გამზირი", "გზატკეცილი", "სოფელი")
MIN_TEXT_CHARS = 48
BROKEN_GLYPH = "(cid:"

# --- line items in document text -----------------------------------------
ITEM_NAME_HEADERS = (
    "საქონლის დასახელება",
    "დასახელება",
    "სახელი",
    "ნივთი",
    "პროდუქტ",
    "name",
    "product",
    "item",
)
PLAIN_TOTAL_WORDS = ("სულ", "total")
BUNDLED_TOTAL_WORDS = ("სულ", "total", "#")
BUNDLED_HEADER_WORDS = ("საქონლის დასახელება", "ზომის ერთეული")
PLAIN_ITEM = r"^(.+?)\s+(\d+(?:[.,]\d+)?)\s+(\d+(?:[.,]\d+)?)\s*$"
PLAIN_ITEM_MIN = 5
BUNDLED_ITEM = r"(.+?)\s+(\d{13})\s+(.+)$"
BUNDLED_ITEM_MIN = 25
BUNDLED_ROW_NUMBER = r"^#?\s*\d{1,3}\s+"
BUNDLED_UNIT = r"^ცალი\s+"
TAIL_DECIMAL = r"\d+\.\d{2,4}"
LABEL_TABLE_PREFIX = r"^\|?\s*\d+\s*\|\s*"
LABEL_ROW_PREFIX = r"^\d+\.\s*"
