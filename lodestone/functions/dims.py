"""Lookup values. They must be these for right results."""

# Query parameters that only track.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source", "si", "sxsrf", "ved", "ei", "gs_lcp", "sclient"]

# Quality of domains, the first that matches counts; a leading dot matches as a suffix.
DOMAIN_QUALITY = {
    "default": [("wikipedia.org", 0.95), ("github.com", 0.90), ("stackoverflow.com", 0.90), ("docs.python.org", 0.95), ("developer.mozilla.org", 0.95), ("arxiv.org", 0.90), ("nature.com", 0.90), ("science.org", 0.88), ("medium.com", 0.70), ("dev.to", 0.70), ("hacker-news.firebaseio.com", 0.70)],
    "zh-TW": [
        (".gov.tw", 0.95), (".edu.tw", 0.95), ("cna.com.tw", 0.90), ("udn.com", 0.88), ("ltn.com.tw", 0.88), ("ctee.com.tw", 0.88), ("cnyes.com", 0.88), ("twse.com.tw", 0.95),
        ("ithome.com.tw", 0.80), ("techbang.com", 0.78), ("moneydj.com", 0.80), ("pansci.asia", 0.78), ("ptt.cc", 0.65), ("mobile01.com", 0.65), ("tw.stock.yahoo.com", 0.75), ("goodinfo.tw", 0.75), ("histock.tw", 0.72),
        ("cmoney.tw", 0.72), ("wantgoo.com", 0.72), ("statementdog.com", 0.72), ("vocus.cc", 0.60), ("medium.com", 0.60), ("kknews.cc", 0.15), ("twgreatdaily.com", 0.15), ("read01.com", 0.15), ("itw01.com", 0.15),
    ],
    "en": [("reuters.com", 0.90), ("apnews.com", 0.90), ("bbc.com", 0.85), ("nytimes.com", 0.85), ("theguardian.com", 0.82), ("washingtonpost.com", 0.82), ("techcrunch.com", 0.75), ("arstechnica.com", 0.78), ("dev.to", 0.70), ("medium.com", 0.68)],
}
DEFAULT_QUALITY = 0.50

# Chinese stop words, navigation words of snippets, hosts that are not crawled.
ZH_STOP_WORDS = "的 了 在 是 我 有 和 就 不 人 都 一 一個 上 也 很 到 說 要 去 你 會 著 沒有 看 好 自己 這".split()
NAV_WORDS = ["home", "首頁", "menu", "navigation", "skip to content", "跳至", "下載app", "訪客", "更多"]
SKIP_DOMAINS = [
    "www.zhihu.com", "zhihu.com", "zhuanlan.zhihu.com", "zhidao.baidu.com", "tieba.baidu.com", "www.xiaohongshu.com", "weibo.com", "www.weibo.com", "mp.weixin.qq.com", "www.bilibili.com", "www.douyin.com",
    "twitter.com", "x.com", "www.facebook.com", "facebook.com", "www.instagram.com", "www.tiktok.com", "www.linkedin.com", "www.quora.com",
]

# Patterns of pages that stop robots, of prompt injection, of advertisements and of boilerplate.
BOT_PATTERNS = [
    r"security\s*verification", r"verif(?:y|ying)\s+(?:you\s+are\s+)?(?:not\s+)?(?:a\s+)?(?:bot|robot|human)", r"checking\s+(?:if\s+)?(?:the\s+)?site\s+connection\s+is\s+secure",
    r"enable\s+javascript\s+(?:and\s+cookies\s+)?to\s+continue", r"access\s+(?:to\s+)?this\s+(?:page|site)\s+has\s+been\s+denied", r"cloudflare|hcaptcha|recaptcha", r"just\s+a\s+moment.*?(?:please\s+wait|loading)",
    r"請\s*完成\s*(?:安全\s*)?驗證", r"ray\s*id\s*:", r"please\s+(?:enable|turn\s+on)\s+javascript",
]
INJECTION_PATTERNS = [
    r"<\s*/?\s*system\s*>", r"<\s*/?\s*assistant\s*>", r"<\s*/?\s*human\s*>", r"<\s*/?\s*user\s*>", r"\bignore\s+(all\s+)?previous\s+instructions\b", r"\byou\s+are\s+now\b",
    r"\bact\s+as\s+(an?\s+)?(admin|root|system)\b", r"\[SYSTEM\]", r"```\s*system\b",
]
AD_PATTERNS = [
    r"廣告|贊助|推薦連結|業配", r"立即購買|點此領取|限時優惠|免費試用", r"立即申辦|馬上申請|立即開通|立即體驗", r"立即下載|掃描立即下載|下載App", r"sponsored|promoted|advertisement",
    r"buy now|click here|free trial|limited offer", r"sign up now|download now|get started free", r"\b(aff|affiliate|partner|tracking|utm_\w+|ref|campaign)(\?|=)",
]
#: Of each advertisement's pattern what a text must hold, in lower case (and a letter that only folds to s).
AD_STEMS = [
    "廣告", "贊助", "推薦連結", "業配", "立即購買", "點此領取", "限時優惠", "免費試用", "立即申辦", "馬上申請", "立即開通", "立即體驗", "立即下載", "下載app", "sponsored", "promoted", "advertisement",
    "buy now", "click here", "free trial", "limited offer", "sign up now", "download now", "get started free", "aff?", "aff=", "affiliate?", "affiliate=", "partner?", "partner=", "tracking?", "tracking=", "utm_",
    "ref?", "ref=", "campaign?", "campaign=", "ſ",
]
#: Of each boilerplate's pattern what a block must hold, in lower case (and letters that only fold to k and s).
BOILERPLATE_STEMS = [
    "隱私權政策", "cookie", "關於我們", "聯絡我們", "客服中心", "登入", "回到頂部", "下載", "服務條款", "使用條款", "版權所有", "著作權", "訂閱電子報", "追蹤我們", "分享至", "加入書籤", "場地租借", "意見回饋", "檢舉", "成為", "加入我們",
    "回報問題", "意見反饋", "立即免費探索", "免費體驗", "立即體驗", "免費試用", "立即開始", "立即加入", "馬上體驗", "立即探索", "privacy", "terms", "about", "contact", "sign", "back", "download", "subscribe", "follow", "share", "newsletter",
    "right", "©", "report", "join", "careers", "powered", "built", "\u212a", "ſ",
]
#: Named entities that occur in text; of the public table.
NAMED_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "amp": "&", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "laquo": "«", "raquo": "»", "bull": "•", "middot": "·", "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "sect": "§", "para": "¶", "shy": "\u00ad",
    "zwj": "\u200d", "zwnj": "\u200c", "lrm": "\u200e", "rlm": "\u200f", "lbrace": "{", "rbrace": "}", "lbrack": "[", "rbrack": "]", "lsqb": "[", "rsqb": "]", "sol": "/", "colon": ":", "num": "#", "excl": "!", "lpar": "(", "rpar": ")", "Tab": "\t", "NewLine": "\n",
}
BOILERPLATE = (
    r"隱私權政策|Cookie\s*政策|關於我們|聯絡我們|客服中心|登入[/／]註冊|登入\s*註冊|回到頂部|下載\s*App|服務條款|使用條款|版權所有|著作權|訂閱電子報|追蹤我們|分享至|加入書籤|場地租借|意見回饋|檢舉|成為.*作者|加入我們|回報問題|意見反饋"
    r"|立即免費探索|免費體驗|立即體驗|免費試用|立即開始|立即加入|馬上體驗|立即探索"
    r"|Privacy\s*Policy|Terms\s*of\s*Service|Cookie\s*Policy|About\s*Us|Contact\s*Us|Sign\s*In|Sign\s*Up|Back\s*to\s*Top|Download\s*App|Subscribe\s*Now|Follow\s*Us|Share\s*this|Newsletter|Unsubscribe"
    r"|All\s*Rights?\s*Reserved|©\s*\d{4}|Report\s*(?:a\s*)?Bug|Join\s*Us|Careers|Powered\s*by|Built\s*with"
)

# Networks that a fetch must not reach (IPv6, IPv4), and hours after which a result's freshness halves.
BLOCKED_NETWORKS_6 = ["::1/128", "fc00::/7", "fe80::/10"]
BLOCKED_NETWORKS = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15"]
HALF_LIVES = {"any": 8760.0, "day": 12.0, "week": 84.0, "month": 360.0}
HALF_LIFE_OTHER = 720.0
WEIGHTS = {"lexical": 0.25, "semantic": 0.20, "quality": 0.20, "freshness": 0.15, "language": 0.20}

#: A short list of our own; the caller can give another.
EN_STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the this to was were will with not you which we they i his her but have had".split()
