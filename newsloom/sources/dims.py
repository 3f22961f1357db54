"""Dimension and rule tables. All are small and fixed, so they're literals of expressions or broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Source, language, kind, base weight, crowd scale.
SOURCES = [
    ("OpenAI", "en", "primary", 80, 1.0), ("Anthropic", "en", "primary", 80, 1.0), ("DeepMind", "en", "primary", 70, 1.0), ("Google AI", "en", "primary", 70, 1.0),
    ("Meta AI", "en", "primary", 70, 1.0), ("Mistral", "en", "primary", 70, 1.0), ("Claude Code", "en", "primary", 70, 1.0), ("xAI", "en", "primary", 60, 1.0),
    ("Qwen", "en", "primary", 60, 1.0), ("Cursor", "en", "primary", 60, 1.0), ("NVIDIA", "en", "primary", 50, 1.0), ("Ollama", "en", "primary", 50, 1.0),
    ("Windsurf", "en", "primary", 50, 1.0), ("GitHub Blog", "en", "primary", 50, 1.0), ("LangChain", "en", "primary", 50, 1.0), ("AWS ML", "en", "primary", 40, 1.0),
    ("Vercel", "en", "primary", 40, 1.0), ("HuggingFace", "en", "primary", 35, 1.0), ("arXiv", "en", "primary", 25, 1.0), ("Simon Willison", "en", "secondary", 65, 1.0),
    ("Latent Space", "en", "secondary", 60, 1.0), ("smol.ai", "en", "secondary", 60, 1.0), ("Import AI", "en", "secondary", 55, 1.0), ("Changelog", "en", "secondary", 50, 1.0),
    ("GitHub Trending", "en", "secondary", 50, 0.5), ("Lobsters", "en", "secondary", 30, 5.0), ("Hacker News", "en", "secondary", 20, 1.0),
    ("Zenn", "ja", "secondary", 35, 1.0), ("Hatena", "ja", "secondary", 25, 1.5), ("Qiita", "ja", "secondary", 20, 4.0),
]

# Keywords and the bonus that any of them adds once.
BONUS_RULES = [
    (["gpt-5", "gpt-6", "claude", "gemini", "llama"], 20),
    (["agent", "agentic", "tool use", "function calling", "mcp", "エージェント"], 15),
    (["open source", "open-source", "weights released", "オープンソース", "重み公開"], 15),
    (["dev tool", "developer", "productivity", "observability", "workers", "d1", "r2", "実装", "検証", "試し", "入門", "解説", "開発"], 12),
    (["rag", "retrieval", "検索拡張"], 10),
    (["safety", "alignment", "red team", "アライメント", "脆弱性"], 10),
    (["benchmark", "sota", "state-of-the-art"], 5),
]

# Categories in order, with the keywords that give them.
CATEGORY_RULES = [
    ("LLM", ["llm", "language model", "gpt", "claude", "gemini", "llama", "mistral", "chatgpt"]),
    ("Agent", ["agent", "agentic", "tool use", "function calling", "mcp"]),
    ("RAG", ["rag", "retrieval augmented", "retrieval-augmented", "vector search", "embedding"]),
    ("Vision", ["vision", "image", "visual", "multimodal", "video", "diffusion"]),
    ("Multimodal", ["multimodal", "multi-modal", "audio", "speech", "voice"]),
    ("RL", ["reinforcement learning", "rlhf", "reward model", "ppo", "dpo"]),
    ("Code", ["code", "coding", "copilot", "ide", "programming", "swe-bench", "cursor", "windsurf", "claude code", "codex", "qwen-coder"]),
    ("Safety", ["safety", "alignment", "red team", "jailbreak", "guardrail", "constitutional"]),
    ("Infrastructure", ["inference", "gpu", "tpu", "quantization", "serving", "kubernetes", "deploy"]),
    ("Open Source", ["open source", "open-source", "weights", "apache", "mit license", "hugging face"]),
    ("Product", ["launch", "release", "announce", "available", "introducing", "new feature"]),
    ("Research", ["paper", "arxiv", "research", "study", "findings", "experiment"]),
]

# Keyword lists of the ingestion filters.
KEYWORDS = ["ai", "llm", "gpt", "claude", "gemini", "llama", "mistral", "qwen", "language model", "machine learning", "neural", "transformer", "diffusion", "open source model", "agent", "agentic", "mcp", "anthropic", "openai", "deepmind", "hugging face", "huggingface", "inference", "fine-tun", "rlhf", "embedding", "vector", "copilot", "prompt", "rag"]
KEYWORDS_JA = ["生成ai", "大規模言語モデル", "言語モデル", "機械学習", "深層学習", "ディープラーニング", "ニューラル", "拡散モデル", "画像生成", "動画生成", "音声認識", "マルチモーダル", "強化学習", "ファインチューニング", "埋め込み", "ベクトル検索", "エージェント", "プロンプト", "推論", "llm", "rag", "mcp", "claude", "gpt", "gemini", "transformer", "copilot", "openai", "anthropic"]

# Feeds by source, with the keywords that an item needs (none: any) and the days it may be old.
FEEDS = [
    ("OpenAI", "https://openai.com/news/rss.xml", None, None),
    ("DeepMind", "https://deepmind.google/blog/rss.xml", None, None),
    ("Google AI", "https://blog.google/technology/ai/rss", None, None),
    ("Meta AI", "https://research.facebook.com/feed/", ["ai", "llm", "language model", "machine learning", "neural", "transformer"], None),
    ("arXiv", "https://rss.arxiv.org/rss/cs.AI", None, None),
    ("arXiv", "https://rss.arxiv.org/rss/cs.CL", None, None),
    ("arXiv", "https://rss.arxiv.org/rss/cs.LG", None, None),
    ("NVIDIA", "https://blogs.nvidia.com/feed/", ["ai", "llm", "gpu", "inference", "training", "cuda", "tensor"], None),
    ("AWS ML", "https://aws.amazon.com/blogs/ai/feed/", None, None),
    ("Mistral", "https://mistral.ai/rss.xml", None, None),
    ("xAI", "https://raw.githubusercontent.com/Olshansk/rss-feeds/main/feeds/feed_xainews.xml", None, None),
    ("Ollama", "https://raw.githubusercontent.com/Olshansk/rss-feeds/main/feeds/feed_ollama.xml", None, None),
    ("Qwen", "https://github.com/QwenLM/Qwen3/releases.atom", None, None),
    ("Claude Code", "https://raw.githubusercontent.com/Olshansk/rss-feeds/main/feeds/feed_anthropic_changelog_claude_code.xml", None, None),
    ("Cursor", "https://raw.githubusercontent.com/Olshansk/rss-feeds/main/feeds/feed_cursor.xml", None, None),
    ("Windsurf", "https://raw.githubusercontent.com/Olshansk/rss-feeds/main/feeds/feed_windsurf_blog.xml", None, None),
    ("GitHub Blog", "https://github.blog/feed/", ["copilot", "ai", "code", "agent"], None),
    ("LangChain", "https://blog.langchain.dev/rss/", None, None),
    ("Vercel", "https://vercel.com/atom", ["ai", "v0", "sdk"], None),
    ("Simon Willison", "https://simonwillison.net/atom/everything/", KEYWORDS, None),
    ("Import AI", "https://importai.substack.com/feed", None, None),
    ("Latent Space", "https://www.latent.space/feed", None, None),
    ("Changelog", "https://changelog.com/feed", KEYWORDS, None),
    ("smol.ai", "https://news.smol.ai/rss.xml", None, 7),
]

# Queries and topics of generated feeds, their URLs, and the bookmarks that a query's item needs.
HATENA_QUERIES, HATENA_URL = ["生成AI", "LLM", "Claude Code", "機械学習"], "https://b.hatena.ne.jp/q/{q}?sort=recent&mode=rss"
ZENN_TOPICS, ZENN_URL = ["llm", "生成ai", "claudecode", "ai"], "https://zenn.dev/topics/{q}/feed"
HATENA_FIELD, HATENA_LEAST, GENERATED_DAYS = "hatena:bookmarkcount", 10.0, 7

# Reaction names by action, and the rank of a status.
STARRED = ["star", "star2", "glowing_star", "stars", "sparkles", "fire", "100", "heart", "heart_eyes", "heartpulse", "tada", "clap", "raised_hands", "bookmark", "pushpin", "bulb"]
READ = ["white_check_mark", "heavy_check_mark", "ballot_box_with_check", "eyes", "eye", "+1", "thumbsup", "-1", "thumbsdown", "ok_hand", "ok", "pray"]
STATUS_RANK = {"Unread": 0, "Digested": 1, "Read": 2, "Starred": 3}

# Limits.
CROWD_WEIGHT, CROWD_MAX, MIN_SCORE, PER_SOURCE, DEFAULT_WEIGHT = 18, 60, 30, 8, 30


def source_dim(spark: SparkSession, rows: list[tuple] = SOURCES) -> DataFrame:
    return spark.createDataFrame(rows, "source string, lang string, kind string, weight int, crowd_scale double")
