"""Default rule parameters.

The operators take these as arguments, so a deployment for other minutes can pass its own.
"""

# --- Fixed values: the results depend on these lists and on their order ---------------

# Roles that end a speaker's name on a marker line, in the order they are tried.
SPEECH_ROLES = (
    "予算決算常任委員長", "総務文教常任委員長", "産業建設常任委員長", "産業厚生常任委員長",
    "常任委員長", "特別委員長", "委員長", "副委員長", "副議長", "議長", "議員",
    "副市長", "市長", "教育長", "総務部長", "企画部長", "財政課長", "危機管理監",
    "部長", "課長", "局長", "参事", "次長", "監査委員", "委員", "事務局長",
)

# Roles that precede a name in the attendee list.
ATTENDEE_ROLES = (
    "予算決算常任委員長", "総務文教常任委員長", "産業建設常任委員長", "産業厚生常任委員長",
    "常任委員長", "特別委員長", "副委員長", "委員長", "副議長", "議長",
    "副市長", "市長", "教育長", "総務部長", "企画部長", "市民部長", "福祉保健部長",
    "産業部長", "建設部長", "消防長", "危機管理監", "財政課長", "総務課長", "会計管理者",
    "水道局長", "農業委員会事務局長", "教育次長", "部長", "課長", "局長", "参事", "次長",
    "監査委員", "委員", "事務局長", "書記",
)

# Two-character starts of organisation names; a person's name is cut before one.
ORGANISATION_BIGRAMS = (
    "総務", "政策", "企画", "事務", "社会", "福祉", "建設", "産業",
    "教育", "危機", "財政", "会計", "水道", "農業", "消防", "子育",
    "環境", "市民", "都市", "管理", "統括", "保健", "上下", "生活",
)

# Family names of one character.
ONE_CHAR_FAMILY_NAMES = (
    "林", "森", "原", "関", "堀", "辻", "東", "西", "谷", "泉", "柳", "杉", "馬", "沢",
)

# Attendee section headers (matched on the line without whitespace, first hit wins).
SECTION_HEADERS = (
    ("出席議員", "councilor"),
    ("出席委員", "councilor"),
    ("説明のため出席した者", "executive"),
    ("規定により出席した者", "executive"),
    ("事務局の職氏名", "staff"),
    ("事務局職員", "staff"),
)

# Heading text -> kind of the links below it (first hit wins).
SECTION_KINDS = (
    ("定例会|定例議会", "regular"),
    ("臨時会|臨時議会", "extra"),
    ("委員会", "committee"),
)

SESSION_LABELS = {
    "regular": "定例会",
    "extra": "臨時会",
    "committee": "委員会",
    "budget_committee": "予算委員会",
    "other": "その他",
}

STOP_WORDS = (
    "これ", "それ", "あれ", "この", "その", "ここ", "そこ", "こと", "もの",
    "ため", "よう", "ところ", "わけ", "はず", "つもり", "ほう", "ほか",
    "とき", "とこ", "あと", "まま", "ほど", "くらい", "ぐらい",
    "中", "上", "下", "前", "後", "方", "等", "的", "性", "化", "者",
    "私", "僕", "皆", "皆さん", "議員", "さん", "氏",
    "年", "月", "日", "号", "回", "点", "件", "人", "分", "円",
    "一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "百", "千", "万",
    "以上", "以下", "以内", "以外", "場合", "部分", "全体", "意味",
    "質問", "答弁", "説明", "議長", "委員", "市長",
)
NOUN = "名詞"
DROPPED_NOUN_KINDS = ("代名詞", "非自立", "接尾", "数")

MARKER = "○"
UNKNOWN_SPEAKER = "不明"
COUNCILOR_ROLE = "議員"
MAX_MARKER_NAME = 8
MAX_PERSON_NAME = 6
CONFIDENCE_VALUES = {"high": 1.0, "medium": 0.7, "low": 0.3}
ALIAS_PRIORITY = {"manual": 3, "attendee_derived": 2, "speech_derived": 1}
MIN_WORD_LENGTH = 2
WORDS_KEPT, WORDS_SERVED, WORDS_SHOWN = 500, 200, 100
TOKEN_LIMIT = 12_000
PART_HEADING = ("## パート", "の要約\n")

# --- End of fixed values -------------------------------------------------------------

# Rows of one key are scanned in blocks so that no task has to hold a whole key.
PAGES_PER_BLOCK = 1024
ROWS_PER_BLOCK = 65_536
SPEECHES_PER_BLOCK = 4_096
