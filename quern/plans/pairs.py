"""Sentence pairs for calibration where no benchmark is at hand."""

#: Labelled sentence pairs for calibration without a benchmark file, with scores from 0 to 5.
BUILT_IN_PAIRS = [
    ("Use Python for NLP4RE tool development to ensure reusability.", "Implement NLP4RE solutions in Python to improve reusability of existing tools.", 4.8),
    ("Configure the depth parameter to control Wikipedia traversal depth.", "Set the depth parameter to adjust how deeply Wikipedia categories are traversed.", 4.6),
    ("Use WikiDoMiner to generate a domain-specific corpus from requirements.", "Apply WikiDoMiner to build a domain corpus for your requirements specification.", 4.5),
    ("Adopt Python libraries for NLP to avoid Java maintenance issues.", "Use Python-based NLP libraries to prevent outdated Java dependency problems.", 4.3),
    ("Prioritize code smells in the predominant programming paradigm.", "Focus code smell research on the dominant paradigm of the target language.", 4.2),
    ("Release tools under open-source licenses to enable community reuse.", "Publish NLP4RE tools as open-source to foster community adoption and reuse.", 4.4),
    ("Evaluate models on domain-specific benchmarks rather than generic ones.", "Test NLP tools on domain-specific datasets not only standard NLP benchmarks.", 4.1),
    ("Pre-train language models on domain corpora before fine-tuning.", "Fine-tune pre-trained models on domain-specific text prior to deployment.", 3.9),
    ("Configure corpus depth parameter for Wikipedia category traversal.", "Use WikiDoMiner to generate domain-specific corpora for NLP tasks.", 2.8),
    ("Implement tools in Python for reusability across NLP4RE ecosystem.", "Release NLP tools under open-source licenses for community adoption.", 2.2),
    ("Use Python for NLP4RE tool development.", "Prioritize code smells in the predominant paradigm.", 0.8),
    ("Configure depth parameter for Wikipedia traversal.", "Release tools under open-source licenses.", 0.5),
    ("Apply WikiDoMiner to generate domain corpus.", "Use static analysis to detect Python anti-patterns.", 0.3),
    ("Adopt Python for NLP tooling.", "Pre-train language models on domain corpora.", 1.2),
    ("Configure corpus depth for Wikipedia traversal.", "Evaluate models on domain-specific benchmarks.", 0.9),
    ("Use Python libraries instead of Java.", "Prioritize smells in dominant programming paradigm.", 0.4),
]
