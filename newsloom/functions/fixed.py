"""Word lists, patterns and constants that decide the results, stated once and used everywhere else."""

# --- fixed values: article cleaning ---
AGENCIES = r"(Reuters|AP|Associated Press|AFP|Bloomberg|BBC|CNN|NPR|WSJ|NYT|CNBC|The Guardian)"
MONTHS = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\.?"
CITY_CHAIN = r"(?:[A-Z0-9][A-Za-z0-9.'-]*(?:\s+[A-Z0-9][A-Za-z0-9.'-]*)*(?:/\s*[A-Z0-9][A-Za-z0-9.'-]*(?:\s+[A-Z0-9][A-Za-z0-9.'-]*)*)*)"
AFTER_AGENCY = r"\s*(?:[-–—]\s*)?"
CORRECTION = r"^\([^)]*\)\s*"
LEADING_QUOTES = r"^[\"“”']+\s*"
LEADING_DASH = r"^\s*[-–—]\s*"
REPEAT_AGENCY = rf"^(?:\s*\({AGENCIES}\){AFTER_AGENCY})+"
GENERIC_DATELINE = (
    r"^\s*[\"“”']?[A-Z0-9][A-Z0-9 .,'/-]*(?:/[A-Z0-9][A-Z0-9 .,'/-]*)*(?:,\s*[A-Za-z.]+(?:\s+[A-Za-z.]+)*)?"
    rf"(?:,\s*{MONTHS}\s+\d{{1,2}}(?:,\s*\d{{4}})?)?\s*\({AGENCIES}\){AFTER_AGENCY}"
)
CITY_DATELINE = rf"^\s*[\"“”']?{CITY_CHAIN}(?:,\s*[A-Za-z.]+)?\s*\({AGENCIES}\){AFTER_AGENCY}"
CITY_DATE_DATELINE = rf"^\s*[\"“”']?{CITY_CHAIN}\s*,\s*{MONTHS}\s+\d{{1,2}}(?:,\s*\d{{4}})?\s*\({AGENCIES}\){AFTER_AGENCY}"
#: Our decision: a byline is closed by a dash, or fills a line without a full stop. Other texts may begin with "By" and capitals ("By As
#: en ..", "By By By") and keep them, as the queries' SQL says; the names of an open byline can't be told from the sentence after it.
NAMES = r"[A-Z][A-Za-z.'-]+(?:[^\S\n]+[A-Z][A-Za-z.'-]+)*"
BYLINE = (
    rf"^\s*By\s+(?!By\b){NAMES}(?:\s+and\s+{NAMES})?"
    r"(?:(?:\s+in\s+[A-Za-z0-9 .,'/-]+)?(?:\s+-|\s*[–—])\s*|(?:[^\S\n]+in[^\S\n]+[A-Za-z0-9 ,'/-]+)?(?<!\.)[^\S\n]*\n\s*)"
)
SAFETY_NET = rf"^\s*.{{0,120}}?\({AGENCIES}\){AFTER_AGENCY}"
URL = r"https?://\S+|www\.\S+"
BARE_DOMAIN = r"\b[a-zA-Z0-9.-]+\.(com|org|net|gov|edu|co|io)\b(/\S*)?"
HANDLE = r"\(@[A-Za-z0-9_]+\)|@[A-Za-z0-9_]+"
PICTURE_LINK = r"pic\.twitter\.com/\S+"
PHOTO_BY = r"Photo by .*"
SAID_ON = (
    r"\bsaid\s+on\s+(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|Jan|January|Feb|February|Mar|March|Apr|April|May|"
    r"Jun|June|Jul|July|Aug|August|Sep|Sept|September|Oct|October|Nov|November|Dec|December)(?:\s+\d{1,2})?(?:st|nd|rd|th)?"
    r"(?:\s+(?:morning|afternoon|evening|night))?\b"
)
READ_MORE = r"read more(?:\s*\.\.\.)?\s*(?:.*?\s+news\s+)?(?:at\b:?|:).*"
DID_NOT_RESPOND = r"\bdid not(?:\s+immediately)?\s+respond to\b"
SOURCE_LINK_TAIL = r"((?:\[\s*\d{1,4}(?::\d{2})?\s*[a-zA-Z]{2,5}\s*\]\s*)?--\s*source\s+link\s*:).*"
BOILERPLATE = (
    r"\(\s*reporting by .*?\)",
    r"\(\s*editing by .*?\)",
    r"\(\s*reporting by .*?;\s*editing by .*?\)",
    r"this article was funded in part by .*?\.",
    r"it was independently created by the .*? editorial staff\.",
    r".*? had no editorial involvement in its creation or production\.",
    r"did not immediately respond to a request for comment\.",
    r"did not respond to a request for comment\.",
    r"respond to a request for comment\.",
)
#: What a text must hold for each of the above to match anywhere: cheap to look for, where the pattern is not.
BOILERPLATE_NEEDS = (
    "reporting by ", "editing by ", "reporting by ", "this article was funded in part by ", "it was independently created by the ",
    " had no editorial involvement in its creation or production.", "did not immediately respond to a request for comment.",
    "did not respond to a request for comment.", "respond to a request for comment.",
)
TAIL_MARKERS = ("featured image via", "feature via image", "image via", "for entire story:")
LATE_MARKER = "via:"
TAIL_SHARE = 0.7
SITE_NAMES = (r"\b21wire\.tv\b", r"\b21wire\b")
RADIO_PROMO = ("alternate current radio network", "uncensored, uninterruptible talk radio", "social rejects club", "direct download episode")
SCRIPT_HINTS = (
    "getelementbyid", "getelementsbytagname", "createelement", "removeeventlistener", "detachevent", "addeventlistener",
    "settimeout", "setinterval", "onload", "onerror", "data:image", "base64", "decodeuricomponent", "appendchild",
    "insertbefore", "parentnode", "javascript", "math.max", "parsefloat", "indexof", "google image requests", "document",
    "window", "pcode", "playerbrandingid", "oo.ready", "oo.player.create", "playerparam", "container",
)
SCRIPT_STRETCHES = (
    r"[^\n]{0,300}(?:getelementbyid|getelementsbytagname|createelement|appendchild|insertbefore)[^\n]{0,300}",
    r"[^\n]{0,300}(?:removeeventlistener|detachevent|addeventlistener|onload|onerror)[^\n]{0,300}",
    r"[^\n]{0,300}(?:data:image|base64|decodeuricomponent|parsefloat|math\.max|indexof)[^\n]{0,300}",
    r"[^\n]{0,300}(?:javascript|parentnode|settimeout|setinterval|google image requests)[^\n]{0,300}",
    r"[^\n]{0,400}(?:pcode|playerbrandingid|oo\.ready|oo\.player\.create|playerparam|container)[^\n]{0,400}",
)
CODE_WORD = r"\b(?:function|var|return|throw|try|catch|finally|case|switch|break|null|true|false)\b"
CODE_SYMBOL = r"[{}();=!<>]"
NOT_KEPT = r"""[^A-Za-z0-9一-鿿\s\.,!?;:'"()\-\[\]{}，。！？；：「」『』】【（）《》、—…]"""
SCRIPT_ELEMENT = r"<script\b.*?</script>"
STYLE_ELEMENT = r"<style\b.*?</style>"
TAG = r"<[^>]+>"
HAN = r"[一-鿿]"
LATIN_TOKEN = r"[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*"
LEAST_TOKENS = 5

# --- fixed values: body extraction ---
PARAGRAPH_NOISE = (
    "(我們使用cookie|使用 cookie|隱私|版權所有|訂閱電子報|追蹤我們|條款|隱私權政策|cookie policy|privacy|terms of service|"
    "enable cookies|accept cookies|consent|manage preferences|贊助|廣告|sponsored|advertisement|留言|評論區|熱門文章|延伸閱讀|你可能還喜歡)"
)
NODE_NOISE = (
    r"(cookie|consent|gdpr|banner|popup|modal|subscribe|newsletter|share|social|follow|breadcrumb|nav|header|footer|sidebar|"
    r"ad-|ads|advert|advertise|promo|promoted|sponsor|sponsored|outbrain|taboola|widget|recommend|related|trending|"
    r"comment|reply|login|register|paywall|caas-readmore|caas-related|caas-carousel|caas-more-from|related-articles|related-news|"
    r"more-stories|recommendation-contents|comments-wrapper|share-button-group|read-more-vendor|recommended-article-stream|"
    r"module-coview|StretchedBox|D\(f\)|Pos\(r\))"
)
LINE_NOISE = (
    "(cookie|cookies|隱私|privacy|GDPR|條款|terms|版權|copyright|使用條款|服務條款|訂閱|newsletter|追蹤我們|追蹤|關注|分享|share|social|"
    "延伸閱讀|相關閱讀|你可能還喜歡|熱門|趨勢|trending|留言|評論|comment|reply|廣告|贊助|sponsored|advertisement|promo|outbrain|taboola|推薦|"
    "返回|回到|上一頁|下一頁|閱讀全文|read more)"
)
SENTENCE_END = r"[。．.!?？！]+"
RELATED_HEADINGS = ("延伸閱讀", "相關新聞", "熱門新聞", "更多新聞", "你可能也想看", "推薦閱讀", "更多報導")
CUT_WORDS = (
    *RELATED_HEADINGS, "Yahoo即時新聞", "新頭殼", "三立新聞網", "聯合新聞網", "自由時報", "ETtoday", "nownews", "即時中心", "娛樂中心", "生活中心", "財經中心",
    "更多udn報導", "更多三立新聞網報導", "更多ETtoday報導", "更多中時報導", "更多TVBS報導", "更多聯合報導", "【看原文連結】", "看原文連結",
    "原文出處：", "原文出處:", "(編輯:", "（編輯:",
)
CLOSERS = ("。", "！", "？", ".", "!", "?")
AGENCY_FOOTER = r"[（(](?:核稿)?編輯[：:][^）)]{1,20}[）)]\s*\d{0,7}\s*$"
AGENCY_HEADER = r"^[（(]中央社[^）)]{0,60}(?:專電|日電|電)[）)]\s*"
INLINE_URL = r"https?://[^\s)\]]+|www\.[^\s)\]]+"
EMPTY_SHELLS = ("<html><body></body></html>", "<body></body>", "<html></html>")
PARAGRAPH_LEAST, PARAGRAPH_SURE = 25, 80
LINK_SHARE, URL_SHARE = 0.6, 0.15
MAIN_TEXT_LEAST = 200

# --- fixed values: blocked pages ---
BLOCK_ERRORS = (("403", "http_403"), ("429", "http_429_rate_limit"), ("407", "http_407_proxy_auth"), ("503", "http_503"))
BLOCK_SIGNATURES = (
    "Just a moment", "Checking your browser", "cf-browser-verification", "cf_chl_opt", "Enable JavaScript and cookies to continue",
    "cloudflare-nginx", "__cf_bm", "cf_chl_prog", "Attention Required! | Cloudflare", "Sorry, you have been blocked",
    "This process is automatic", "DDoS protection by Cloudflare", "Performance &amp; security by Cloudflare", "403 Forbidden",
    "Access Denied", "Access denied", "You have been blocked", "您的存取已被封鎖", "您的IP已被封鎖", "存取受限", "異常存取",
    "chinatimes.com/blocked", "請確認您不是機器人", "Too Many Requests", "Rate limit exceeded", "請稍後再試", "g-recaptcha", "hcaptcha",
)
BLOCK_STATUS = (403, 429, 503, 407)
SOFT_BLOCK_LENGTH, SOFT_BLOCK_STRICT, STRICT_HOST = 50, 300, "www.chinatimes.com"

# --- fixed values: URLs ---
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "igshid", "mc_cid", "mc_eid")
KEY_TRACKING = (*TRACKING, "topic")
PATH_SAFE = "/-._~!$&'()*+,;=:@"
TRUSTED_HOSTS = ("news.pts.org.tw", "udn.com", "www.bbc.com", "www.reuters.com", "www.cnn.com", "www.snopes.com")
REFUSED_HOSTS = (
    "www.facebook.com", "www.instagram.com", "www.youtube.com", "twitter.com", "x.com", "www.threads.net", "www.tiktok.com", "line.me",
    "shopee.tw", "www.pchome.com.tw", "www.momo.com.tw", "www.books.com.tw", "www.gov.tw", "www.president.gov.tw", "www.ey.gov.tw",
    "www.ly.gov.tw", "www.mirrormedia.mg", "www.storm.mg", "beforeitsnews.com",
)
PAYWALLED = (
    ("www.chinatimes.com", "/album/memberarticles", "此為中時新聞網會員付費專區文章，無法爬取內容。"),
    ("www.zerohedge.com", "/sponsored-post", "此為 ZeroHedge 贊助廣告內容，非新聞文章，不進行分析。"),
)
#: host (a leading dot: the host or any under it), what the path must match, what it must not match (both may be empty).
ARTICLE_RULES = (
    ("www.cna.com.tw", r"^/news/(?:.*/)?[^/]*\d{6,}[^/]*\.aspx$", ""),
    ("cna.com.tw", r"^/news/(?:.*/)?[^/]*\d{6,}[^/]*\.aspx$", ""),
    ("www.chinatimes.com", r"\d{6,}", r"(?i)^/(?:album/memberarticles|search|tag/|topic/|author/|columnist/)"),
    (".ltn.com.tw", r"/\d{4,}$", ""),
    ("tw.news.yahoo.com", r"\.html$", r"^/(?:topic/|search|weather|politics|entertainment|sports|finance|lifestyle)"),
    ("tw.stock.yahoo.com", r"\.html$", r"^/(?:topic/|search|weather|politics|entertainment|sports|finance|lifestyle)"),
    ("www.zerohedge.com", r"^/.", r"(?i)^/(?:sponsored-post|signup|premium|advertising|why-premium)"),
    ("kknews.cc", r"^/n/[a-z0-9]+\.html$", ""),
    ("www.mission-tw.com", r"^/article/[^/]+/\d+", ""),
    ("www.zanliv.com", r"-\d+/*$", ""),
    ("toments.com", r"^/\d+/?$", ""),
    ("www.distractify.com", r"^/p/[a-z0-9-]+", ""),
    ("www.naturalnews.com", r"^/\d{4}-\d{2}-\d{2}-[a-z0-9-]+\.html$", ""),
    ("naturalnews.com", r"^/\d{4}-\d{2}-\d{2}-[a-z0-9-]+\.html$", ""),
    ("beforeitsnews.com", r"^/[a-z0-9_-]+/\d{4}/\d{2}/.+-\d+\.html$", ""),
    ("www.upworthy.com", r"^/+[^/]*-[^/]*/*$", r"^/+(?:about-us|contact-us|newsletter|partnerships|privacy-policy|terms-of-use|write-for-us)/*$"),
    ("www.thethings.com", r"^/+[^/]*-[^/]*/*$", r"^/+(?:about-us|contact-us|newsletter|partnerships|privacy-policy|terms-of-use|write-for-us)/*$"),
)

# --- fixed values: scores and labels ---
TEMPERATURE, OLD_TEMPERATURE = 0.88, 3.0
BANDS = ((0.8, "Highly Real"), (0.6, "Likely Real"), (0.4, "Uncertain"), (0.2, "Likely Fake"), (None, "Highly Fake"))
RISKS = (
    ("highly real", 1, "高度可信", "模型判定此文章為高度真實。"),
    ("likely real", 2, "可能可信", "模型判定此文章可能為真實。"),
    ("uncertain", 3, "不確定", "模型對此文章真假判斷不確定。"),
    ("likely fake", 4, "可能假新聞", "模型判定此文章可能為假新聞，建議提高警覺。"),
    ("highly fake", 5, "高度假新聞", "模型判定此文章為高度假新聞，建議避免互動。"),
)
UNKNOWN_RISK = (3, "未知", "無法識別分類結果，系統尚未完成分析。")
IN_FLIGHT = ("queued", "crawling", "processing")
FINISHED = ("content_saved", "partial_done", "analysis_done", "failed")
#: Our decision: a blocked URL is finished, so that a client isn't told to wait for it.
FINISHED_OR_BLOCKED = (*FINISHED, "blocked")
SENTENCE_MARKS = ".?!,。？！，"
SPLIT_MARKS = r"[.!?,。？！，\n]"
CANDIDATES, MATCH_LEAST, WINDOW_MOST = 5, 0.30, 1.5
SENTENCE_TOKENS, TOP_TOKENS, TOP_SENTENCES, RELATIVE_SHARE = 8, 7, 3, 0.35
WINDOW, OVERLAP, SPECIALS = 512, 128, 2
CACHE_SECONDS, POLL_SECONDS, HOVER_MS = 300, 30, 200

#: The host of which only articles are looked at, and what begins an article's path.
ARTICLES_ONLY = ("www.mission-tw.com", r"^/article/[^/]+/\d+")

#: Fixed values of the answers that hold no analysis: risk level, risk label, status label, reason.
ANSWERS = {
    "processing": (3, "分析中", "處理中", "系統正在背景爬取並分析此網頁，請稍候..."),
    "analysis_failed": (3, "無法分析", "分析失敗", "此 URL 已嘗試爬取但未能取得有效內容，無法完成分析。"),
    "not_recorded": (3, "未知", "未標記", "資料庫中沒有這個 URL 的標記結果。"),
    "paywalled": (3, "無法分析", "付費/贊助內容", None),
    "skipped_non_article": (3, "不分析", "非文章頁", "此為分類／導覽頁，非單篇文章，系統不予爬取與分析。"),
}
RECORDED_LABEL = "已收錄"

#: Fixed patterns of Markdown and of the body filters, with what takes their place.
MARKDOWN_STEPS = (
    ("(?s)```.*?```", ""), (r"!\[([^\]]*)\]\((?:[^)]+)\)", "$1"), (r"\[([^\]]+)\]\((?:[^)]+)\)", "$1"), ("`([^`]+)`", "$1"),
    (r"(?m)^\s{0,3}#{1,6}\s*", ""), (r"(?m)^\s{0,3}>\s?", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""),
)
BODY_SPANS = (("(?s)```.*?```", " "), (r"!\[[^\]]*\]\([^\)]*\)", " "), (r"\[([^\]]+)\]\((https?://[^\)]+)\)", "$1"), ("`[^`]+`", " "))
MD_HEADING_LINE = r"^\s{0,3}#{1,6}\s+.*$"
MD_OTHER_LINE = r"^\s{0,3}>\s+.*$|^\s{0,3}([*\-\+•·▪◦]|[0-9]+[.)])\s+|^\s{0,3}([-*_])\2{2,}\s*$"
BODY_ENDS = ((r"\*\*|\*|__|_", ""), (TAG, " "), (f"(?i){INLINE_URL}", " "), (r"(?U)\s+", " "), (r"(?U)\s*([。．.!?？！；;,:：，、])\s*", "$1"), (r"([。．!?？！])[。．!?？！]+", "$1"))
BODY_BULLETS = r"^[\-\*\+•·▪◦\d]+\s*"
BODY_READ_ON = "(?:閱讀全文|Read more|更多)$"
#: What ends a sentence before white space; the range keeps other characters from being compared with each wide mark.
BODY_SENTENCE_MARK = r"[.!?;:[\u3002-\uff1f&&[。．？！]]]"

# fixed values: headings of sections with related articles
PRIORITY_SECTIONS = ("推薦文章", "熱門文章", "同分類文章", "相關文章", "查看更多文章", "延伸閱讀", "相關新聞", "更多新聞")
