"""Default rule tables and limits.

Every operator takes its rules as an argument; these are the defaults.
"""

from __future__ import annotations

from typing import NamedTuple

# --- fixed values -----------------------------------------------------------

#: legacy classifier: category -> substring keywords, in tie-break order
CLASSIFIER_KEYWORDS: dict[str, list[str]] = {
    "risk_management": ["risk management", "stop loss", "position size", "drawdown",
                        "risk reward", "account equity", "daily loss"],
    "candlesticks": ["candlestick", "engulfing", "doji", "hammer", "shooting star",
                     "morning star", "evening star"],
    "chart_patterns": ["bear flag", "bull flag", "head and shoulders", "triangle",
                       "double top", "double bottom", "wedge"],
    "strategies": ["strategy", "trend following", "mean reversion", "breakout",
                   "scalping", "momentum"],
    "market_psychology": ["psychology", "fear", "greed", "discipline",
                          "revenge trading", "fomo"],
    "market_behavior": ["market regime", "volatility", "liquidity",
                        "market structure", "trend", "range"],
}


class CategoryRule(NamedTuple):
    name: str
    keywords: tuple[str, ...]
    parent: str | None = None


CATEGORY_RULES = (
    CategoryRule("Forex", ("forex", "foreign exchange", "currency pair", "currency market"),
                 "Financial Markets"),
    CategoryRule("Stocks", ("stocks", "stock market", "equities", "shares"),
                 "Financial Markets"),
    CategoryRule("Crypto", ("crypto", "cryptocurrency", "bitcoin", "ethereum", "blockchain"),
                 "Financial Markets"),
    CategoryRule("Commodities", ("commodities", "commodity", "gold", "crude oil", "futures"),
                 "Financial Markets"),
    CategoryRule("Risk Management", ("risk management", "position sizing", "stop loss",
                                     "risk-reward", "drawdown")),
    CategoryRule("Technical Analysis", ("technical analysis", "chart pattern", "price action",
                                        "candlestick", "trend analysis")),
    CategoryRule("Fundamental Analysis", ("fundamental analysis", "economic data", "earnings",
                                          "interest rate", "macroeconomic")),
    CategoryRule("Trading Psychology", ("trading psychology", "trader psychology", "discipline",
                                        "fear", "greed", "emotional trading")),
    CategoryRule("Order Flow", ("order flow", "order book", "buying pressure",
                                "selling pressure")),
    CategoryRule("Market Structure", ("market structure", "higher high", "lower low",
                                      "break of structure", "liquidity")),
    CategoryRule("Indicators", ("indicator", "rsi", "relative strength index", "moving average",
                                "macd", "bollinger bands", "momentum")),
    CategoryRule("Financial Markets", ("financial markets", "financial market", "trading",
                                       "market")),
    CategoryRule("General", ()),
)

#: listed first when present / used when nothing narrower hits / always present
BROAD_CATEGORY, DEFAULT_CATEGORY = "Financial Markets", "General"

KNOWN_CONCEPTS: dict[str, tuple[str, ...]] = {
    "Financial Markets": ("financial markets", "financial market"),
    "Forex": ("forex", "foreign exchange"),
    "Stocks": ("stocks", "stock market", "equities"),
    "Crypto": ("crypto", "cryptocurrency", "cryptocurrencies"),
    "Commodities": ("commodities", "commodity market"),
    "Risk Management": ("risk management",),
    "Position Sizing": ("position sizing",),
    "Stop Loss": ("stop loss", "stop-loss"),
    "Take Profit": ("take profit", "take-profit"),
    "Risk Reward Ratio": ("risk reward ratio", "risk-reward ratio"),
    "Technical Analysis": ("technical analysis",),
    "Fundamental Analysis": ("fundamental analysis",),
    "Trading Psychology": ("trading psychology", "trader psychology"),
    "Order Flow": ("order flow",),
    "Market Structure": ("market structure",),
    "RSI": ("rsi", "relative strength index"),
    "Moving Average": ("moving average",),
    "Simple Moving Average": ("simple moving average", "sma"),
    "Exponential Moving Average": ("exponential moving average", "ema"),
    "MACD": ("macd", "moving average convergence divergence"),
    "Bollinger Bands": ("bollinger bands",),
    "Support": ("support", "support level"),
    "Resistance": ("resistance", "resistance level"),
    "Momentum": ("momentum",),
    "Trend Analysis": ("trend analysis",),
    "Price Action": ("price action",),
    "Candlestick": ("candlestick", "candlesticks"),
    "Volatility": ("volatility",),
    "Liquidity": ("liquidity",),
    "Leverage": ("leverage",),
    "Drawdown": ("drawdown",),
    "Breakout": ("breakout", "breakouts"),
    "Trading Plan": ("trading plan",),
}

STOPWORDS = (
    "about", "after", "again", "against", "also", "and", "are", "because", "been", "before",
    "being", "between", "both", "but", "can", "could", "does", "each", "for", "from", "have",
    "into", "its", "more", "most", "not", "often", "other", "our", "should", "that", "the", "their",
    "then", "there", "these", "they", "this", "through", "under", "use", "used", "using", "very",
    "was", "were", "when", "where", "which", "while", "with", "would", "you", "your",
)

#: (source concept, relationship type, target concept)
RELATION_RULES = (
    ("Forex", "belongs_to", "Financial Markets"),
    ("Stocks", "belongs_to", "Financial Markets"),
    ("Crypto", "belongs_to", "Financial Markets"),
    ("Commodities", "belongs_to", "Financial Markets"),
    ("RSI", "is_indicator", "Technical Analysis"),
    ("Moving Average", "is_indicator", "Technical Analysis"),
    ("MACD", "is_indicator", "Technical Analysis"),
    ("Bollinger Bands", "is_indicator", "Technical Analysis"),
    ("Moving Average", "used_for", "Trend Analysis"),
    ("Simple Moving Average", "used_for", "Trend Analysis"),
    ("Exponential Moving Average", "used_for", "Trend Analysis"),
    ("Support", "related_to", "Resistance"),
    ("Position Sizing", "part_of", "Risk Management"),
    ("Stop Loss", "used_for", "Risk Management"),
    ("Order Flow", "related_to", "Market Structure"),
)


class TagRule(NamedTuple):
    name: str
    keywords: tuple[str, ...]
    everywhere: bool = False


TAG_RULES = (
    TagRule("beginner", ("beginner", "basic", "basics", "introduction"), True),
    TagRule("advanced", ("advanced", "complex", "institutional"), True),
    TagRule("forex", ("forex", "foreign exchange", "currency pair")),
    TagRule("crypto", ("crypto", "cryptocurrency", "bitcoin", "ethereum")),
    TagRule("stocks", ("stocks", "stock market", "equities", "shares")),
    TagRule("risk", ("risk", "risk management", "position sizing", "stop loss", "drawdown")),
    TagRule("psychology", ("psychology", "discipline", "fear", "greed", "emotion")),
    TagRule("indicator", ("indicator", "rsi", "moving average", "macd", "bollinger bands")),
    TagRule("trend", ("trend", "trend analysis", "moving average")),
    TagRule("support", ("support", "support level")),
    TagRule("resistance", ("resistance", "resistance level")),
    TagRule("momentum", ("momentum", "rsi", "macd")),
    TagRule("price action", ("price action", "candlestick")),
    TagRule("technical", ("technical analysis", "chart pattern", "indicator")),
    TagRule("fundamental", ("fundamental analysis", "earnings", "economic data",
                            "interest rate")),
)

#: claim type -> marker words with their blanks, tested in this order
CLAIM_MARKERS = (
    ("definition", (" is ", " are ", " refers to ")),
    ("causal", (" because ", " leads to ", " results in ")),
    ("instruction", (" should ", " must ", " need to ")),
)
ADVANCED_TERMS = ("advanced", "complex", "institutional", "professional")

#: parser order decides ties: (name, extensions, MIME types)
PARSER_CAPABILITIES = (
    ("pdf", (".pdf",), ("application/pdf",)),
    ("txt", (".txt",), ("text/plain",)),
    ("docx", (".docx",),
     ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)),
    ("markdown", (".md", ".markdown"), ("text/markdown", "text/plain", "text/x-markdown")),
    ("html", (".htm", ".html"), ("application/xhtml+xml", "text/html")),
)

MIME_BY_EXTENSION = {
    "pdf": ("application/pdf",),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",),
    "txt": ("text/plain",),
    "csv": ("text/csv", "text/plain"),
    "md": ("text/markdown", "text/plain"),
    "markdown": ("text/markdown", "text/plain", "text/x-markdown"),
    "html": ("text/html", "application/xhtml+xml"),
    "htm": ("text/html", "application/xhtml+xml"),
    "json": ("application/json", "text/json"),
}
ALLOWED_EXTENSIONS = ("pdf", "docx", "txt", "csv", "md", "markdown", "html", "htm", "json")
ALLOWED_MIME_TYPES = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "text/plain", "text/csv", "text/markdown", "text/x-markdown",
    "text/html", "application/xhtml+xml", "application/json",
)
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL"] + [
    f"{device}{n}" for device in ("COM", "LPT") for n in range(1, 10)
]
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
MAX_HTML_BYTES = 10 * 1024 * 1024
MAX_HTML_NODES = 200_000
MAX_HTML_DEPTH = 100
MIN_USABLE_CHARS = 20

#: ingestion job states: status -> statuses that may follow
JOB_TRANSITIONS = {
    "new": ("queued", "cancelled"),
    "queued": ("reserved", "cancelled"),
    "reserved": ("queued", "running", "cancelled"),
    "running": ("succeeded", "failed", "cancelled"),
    "failed": ("retrying", "cancelled"),
    "retrying": ("reserved", "cancelled"),
    "succeeded": (),
    "cancelled": (),
}
ACTIVE_JOB_STATUSES = ("new", "queued", "reserved", "running", "failed", "retrying")
COMPLETED_JOB_STATUSES = ("succeeded", "failed", "cancelled")
RETRY_LIMIT = 3
UPLOAD_TTL_SECONDS = 3600
LEASE_TTL_SECONDS = 300

IGNORED_HTML_TAGS = ("script", "style", "noscript", "template", "iframe", "object", "embed")
# --- end of fixed values ----------------------------------------------------
