"""Fixed values that results depend on: levels, verb and marker lists, thresholds, pairings. Order is significant."""

LEVELS = {1: "Remember", 2: "Understand", 3: "Apply", 4: "Analyze", 5: "Evaluate", 6: "Create"}
DEFINITIONS = {
    1: "recall facts and basic concepts from the passage",
    2: "explain ideas or concepts in their own words",
    3: "use information in new situations or solve problems",
    4: "draw connections among ideas, compare and contrast",
    5: "justify a stand or decision, critique or evaluate claims",
    6: "produce new or original work, design or propose something",
}
VERBS = {
    1: ["define", "list", "recall", "identify", "name", "state", "what is", "who", "when", "where", "which", "label", "recognize", "match", "select", "memorize"],
    2: ["explain", "describe", "summarize", "interpret", "paraphrase", "illustrate", "discuss", "classify", "compare", "distinguish", "infer", "predict", "restate", "translate"],
    3: ["calculate", "solve", "apply", "demonstrate", "implement", "use", "compute", "determine", "execute", "practice", "operate", "sketch", "modify"],
    4: ["compare", "contrast", "examine", "differentiate", "categorize", "distinguish", "relate", "analyze", "organize", "deconstruct", "attribute", "outline", "investigate"],
    5: ["assess", "critique", "judge", "justify", "argue", "defend", "evaluate", "recommend", "to what extent", "appraise", "prioritize", "rate", "support", "conclude"],
    6: ["design", "develop", "propose", "construct", "formulate", "synthesize", "create", "devise", "plan", "compose", "invent", "produce", "generate", "elaborate"],
}
SUBJECTS = ["biology", "chemistry", "physics", "mathematics", "psychology", "economics", "history", "computer_science"]
PASSAGES_PER_SUBJECT = 15
#: Target level to the level whose vocabulary an adversarial prompt demands.
PAIRINGS = {2: 1, 3: 2, 4: 1, 5: 2, 6: 3, 1: 4}

MIN_WORDS, MIN_WORDS_REMEMBER, MAX_WORDS = 10, 5, 150
MIN_TERMS, MIN_TERMS_REMEMBER, MAX_REPEAT, MIN_CHARS = 2, 1, 3, 5
MAX_CONCEPTS, MAX_ANSWER_WORDS, PASSAGE_OVERLAP = 2, 20, 0.60
MAX_TRIGRAMS, MIN_TRIGRAM_WORDS, SHARED_VOCABULARY = 0.70, 5, 0.20
MIN_CONCEPTS, MIN_SPECS, MIN_ANSWER_WORDS = 2, 2, 50
NLI_WORDS, MAX_CONTRADICTION, MIN_SCENARIO, MIN_CREATION = 400, 0.50, 0.55, 0.60
LOOSE, COMPLETE, MAX_ERRORS = 0.5, 200, 0.10
SEED, RESAMPLES, CONFIDENCE = 42, 1000, 0.95

TASK_STARTERS = ["evaluate", "assess", "critique", "judge", "argue", "defend", "design", "develop", "propose", "construct", "formulate", "create", "devise", "plan", "compose", "synthesize"]
RESPONSE_ENDINGS = ["your argument", "your position", "your response", "your reasoning", "your answer", "your analysis", "your view", "your opinion", "your stance", "the passage", "from the passage", "based on the passage", "with evidence", "with examples"]
QUESTION_WORDS = ["how", "why", "what", "which", "when", "where", "who", "can", "could", "would", "should", "does", "do", "is"]
STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "of", "in", "to", "and", "or", "for", "on", "at", "by", "with", "that", "this", "it", "from", "as", "be", "has", "have", "had", "not", "but", "what", "how", "do", "does", "did", "can", "if", "which", "their", "its", "they", "you", "your"]
ANSWER_STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "of", "in", "to", "and", "or", "for", "on", "at", "by", "with", "it"]
CONCEPT_STOP_WORDS = ["this", "that", "with", "from", "have", "been", "were", "they", "their", "which", "would", "could", "about", "there", "these", "other", "also", "more", "than", "into", "some", "when", "only", "each", "such", "most", "very", "much", "many", "just", "over", "between", "through", "same", "after", "before"]

RECALL = [
    "what is", "what are", "what was", "what were", "what does", "what do", "what did", "what type", "what kind", "what form", "what part",
    "what vitamin", "what molecule", "what organ", "what structure", "what process", "what function", "what role", "what term",
    "what class", "what group", "what phylum", "what percentage", "what number", "what year", "what region", "what stage",
    "how many", "how much", "how long", "how old", "when did", "when does", "when was", "when is", "when were",
    "where is", "where are", "where does", "where do", "where did", "who is", "who was", "who are", "who did", "who discovered",
    "which is", "which are", "which was", "which of", "which type",
]
COMPREHENSION = [
    "why is", "why are", "why does", "why do", "why did", "why was", "why were", "why would", "why can", "why might",
    "how does", "how do", "how is", "how are", "how did", "how was", "how can", "how would", "how might",
    "what is the difference", "what is the purpose", "what is the role", "what is the function", "what is the significance", "what is the meaning",
    "what is the relationship", "what is the importance", "what happens when", "what happens if", "what would happen",
    "what is the effect", "what is the impact", "what is the result", "in what way", "in your own words",
    "what does it mean", "what do you understand", "given that", "considering that",
]
MEANING = ["how", "why", "explain", "describe", "what does", "what do", "in your own words", "in what way", "meaning of"]
APPLICATION = [
    "if a ", "if an ", "if the ", "if you ", "if we ", "given that", "given a ", "given an ", "given the ",
    "suppose ", "assuming ", "consider a ", "consider the ", "imagine ", "say that ", "how would you", "how could you", "how can you",
    "what would happen if", "what would be the result", "what steps", "what procedure", "what method",
    "a researcher", "a student", "a scientist", "an engineer", "a patient", "a doctor",
    "find the", "predict the", "estimate the", "what is the value", "what would the",
]
RESULTS = [
    r"\d+", r"step\s*\d", r"first|second|third|finally", r"result|outcome|solution|output", r"therefore|thus|hence|consequently",
    r"equals?|yields?|produces?|gives?", r"because|since|due to|as a result",
    r"would\s+(be|cause|lead|result|produce|increase|decrease)", r"this\s+(means|indicates|suggests|shows|leads|causes|results)",
    r"the\s+(answer|solution|result|value|effect|consequence)\s+is", r"in\s+this\s+(case|scenario|situation)", r"by\s+(using|applying|following|performing)",
]
ANALYSIS = [
    "how do", "how does", "how is", "how are", "what is the relationship", "what is the connection", "what is the difference", "what are the differences",
    "what is the similarity", "what are the similarities", "in what way", "in what ways", "what role does", "what role do",
    "how do they differ", "how does it differ", "differ from", "different from", "differs from", "similar to", "compared to", "in comparison",
    "what factors", "what causes", "what contributes", "why does", "why do", "why is", "why are",
    "the relationship between", "the connection between", "the difference between", "the similarities between",
]
ACRONYMS = {
    "rer": "rough endoplasmic reticulum", "ser": "smooth endoplasmic reticulum", "er": "endoplasmic reticulum",
    "dna": "deoxyribonucleic acid", "rna": "ribonucleic acid", "mrna": "messenger rna", "trna": "transfer rna",
    "atp": "adenosine triphosphate", "adp": "adenosine diphosphate", "nadh": "nicotinamide adenine dinucleotide",
    "gdp": "gross domestic product", "cns": "central nervous system", "pns": "peripheral nervous system",
}
RELATIONSHIP = ["between", "differ", "relate", "compare", "versus", "whereas", "how does", "affect", "influence", "impact", "connection", "relationship", "similarity", "difference", "in contrast", "as opposed to", "while", "on the other hand"]
CLAIM = [
    "do you agree", "to what extent", "is it justified", "is it true", "is it valid", "would you recommend", "is it appropriate",
    "argue for or against", "defend or refute", "is it reasonable", "critique", "evaluate the claim", "evaluate this claim",
    "assess whether", "some argue", "the claim", "it has been claimed", "one could argue", "is it fair to say",
    "claims that", "it is claimed", "the argument", "should ", "should be", "should not", "could be considered", "can be considered",
    "would it be", "is it possible that", "is it accurate", "is it correct", "is it fair", "justify your", "justify this", "provide reasons",
    "give reasons", "support your", "provide evidence", "provide your reasoning", "strengths and weaknesses", "strengths and limitations",
    "advantages and disadvantages", "pros and cons", "how effective", "how appropriate", "how adequate", "how justified", "how significant", "how valid",
    "how important", "how well does", "how successful", "is there sufficient", "is there enough evidence",
    "what are the limitations", "what are the drawbacks", "what are the implications", "what are the consequences",
    "evaluate whether", "evaluate how", "evaluate the", "critically assess", "critically evaluate", "critically analyze",
    "weigh the", "judge the", "merit of", "your position", "your stance", "your opinion", "your argument", "your view", "take a position", "take a stance",
]
EVIDENCE = ["based on", "evidence", "criteria", "justify", "support", "why or why not", "provide reasons", "give evidence", "what evidence", "using examples", "with reference to"]
ARGUMENT = [
    "however", "although", "on the other hand", "nevertheless", "conversely", "in contrast", "despite", "whereas",
    "notwithstanding", "on the contrary", "nonetheless", "but ", "yet ", "while ", "therefore", "thus", "hence", "consequently",
    "because", "since ", "as a result", "this suggests", "this indicates", "this shows", "the evidence", "the data",
    "more effective", "less effective", "better", "worse", "stronger", "weaker", "superior", "inferior",
    "significant", "insufficient", "adequate", "inadequate", "valid", "invalid", "justified", "unjustified",
    "on one hand", "first,", "second,", "finally,", "in conclusion", "overall", "in summary",
    "the strength", "the weakness", "the limitation", "the advantage", "the disadvantage",
]
SPECS = ["must", "should", "include", "at least", "using", "ensure", "incorporate", "consider", "address", "that includes", "consisting of", "requirements", "criteria"]
SUFFIXES = ["ing", "tion", "sion", "ment", "ness", "ous", "ive", "able", "ible", "ful", "less", "ly", "ed", "er", "est", "es", "s"]
SKIPPED_PAGES = ["key-terms", "chapter-summary", "review-questions", "critical-thinking", "visual-connection", "introduction", "preface", "appendix", "index", "glossary", "further-research", "references", "bibliography", "multiple-choice", "short-answer", "free-response", "practice", "conceptual-questions", "problems", "additional-problems", "challenge-problems", "check-understanding", "section-summary"]

#: (id, name, tier, levels it is for; empty: all), in the order of evaluation.
CONSTRAINTS = [
    ("U1", "is_question", "universal", []), ("U2", "word_count", "universal", []), ("U3", "passage_relevance", "universal", []), ("U4", "no_degenerate", "universal", []),
    ("R1", "remember_vocabulary", "structural", [1]), ("R2", "single_concept", "structural", [1]), ("R3", "short_answer", "structural", [1]), ("R4", "answer_extractable", "structural", [1]),
    ("D1", "understand_vocabulary", "structural", [2]), ("D2", "answer_not_copied", "structural", [2]), ("D4", "asks_meaning", "structural", [2]), ("D3", "answer_supported", "semantic", [2]),
    ("P1", "apply_vocabulary", "structural", [3]), ("P3", "method_reference", "structural", [3]), ("P4", "specific_result", "structural", [3]), ("P2", "new_scenario", "semantic", [3]),
    ("A1", "analyze_vocabulary", "structural", [4]), ("A2", "multiple_concepts", "structural", [4]), ("A3", "asks_relationship", "structural", [4]), ("A4", "answer_coverage", "structural", [4]),
    ("E1", "evaluate_vocabulary", "structural", [5]), ("E2", "presents_claim", "structural", [5]), ("E3", "evidence_request", "structural", [5]), ("E4", "answer_argumentation", "structural", [5]),
    ("C1", "create_vocabulary", "structural", [6]), ("C3", "specifications", "structural", [6]), ("C4", "substantial_answer", "structural", [6]), ("C2", "novel_creation", "semantic", [6]),
    ("AV", "adversarial_vocabulary", "adversarial", []), ("AN", "no_target_vocabulary", "adversarial", []),
]

#: Model, backend, display name, size.
MODELS = [
    ("qwen2.5:14b", "ollama", "Qwen 2.5 14B", "14B"), ("llama3.1:8b", "ollama", "Llama 3.1 8B", "8B"), ("gemma3:12b", "ollama", "Gemma 3 12B", "12B"),
    ("phi4:14b", "ollama", "Phi-4 14B", "14B"), ("deepseek-r1:14b", "ollama", "DeepSeek-R1 14B", "14B"), ("mistral-nemo:12b", "ollama", "Mistral Nemo 12B", "12B"),
    ("gemma2:9b", "ollama", "Gemma 2 9B", "9B"), ("gpt-4o", "openai", "GPT-4o", "~200B"), ("claude-3-5-sonnet-20241022", "anthropic", "Claude 3.5 Sonnet", "~70B"),
    ("gemini-2.5-flash", "google", "Gemini 2.5 Flash", "frontier"), ("deepseek-ai/DeepSeek-V3.1", "together", "DeepSeek-V3.1", "671B MoE"),
    ("meta-llama/Llama-3.3-70B-Instruct-Turbo", "together", "Llama 3.3 70B", "70B"),
]

HINTS = {
    1: "Your question must:\n- Ask for a single, specific fact from the passage\n- Have a short answer (under 20 words) that can be found directly in the text\n- Target only one concept",
    2: "Your question must:\n- Ask for an explanation or interpretation, not just a bare fact\n- Use words like \"how\" or \"why\" or \"explain\"\n- The answer should paraphrase the passage, not copy it word-for-word\n- The answer must still be supported by the passage content",
    3: "Your question must:\n- Present a NEW scenario or problem not described in the passage\n- Require using a method, formula, or principle FROM the passage to solve it\n- Have an answer with a specific result (a number, outcome, or concrete steps)",
    4: "Your question must:\n- Reference at least 2 different concepts from the passage\n- Ask about the relationship between these concepts (compare, contrast, connect)\n- The answer must address all concepts mentioned in the question",
    5: "Your question must:\n- Present a claim or position for the student to evaluate\n- Ask for evidence-based reasoning (use \"justify\", \"based on\", \"why or why not\")\n- The answer should contain argumentation with contrasting viewpoints",
    6: "Your question must:\n- Ask the student to design, create, or propose something original\n- Include at least 2 specific requirements or constraints\n- The answer should be substantial (more than 50 words) and go beyond what's in the passage",
}
# The prompts, whole.
STANDARD_PROMPT = (
    "You are generating an educational question from a textbook passage.\n\nPASSAGE:\n{text}\n\nTASK: Generate a {name}-level question (Bloom's Taxonomy) about this passage.\n\n"
    "At the {name} level, students should be able to {definition}.\n\n{hints}\n\n"
    "Respond in this EXACT format (nothing else):\nQUESTION: [your question]\nANSWER: [a reference answer]"
)
ADVERSARIAL_PROMPT = (
    "You are generating an educational question from a textbook passage.\n\nPASSAGE:\n{text}\n\nTASK: Generate a {name}-level question (Bloom's Taxonomy), but you MUST use vocabulary from the {other} level.\n\n"
    "The cognitive demand of your question must be {name} (students should {definition}), even though the wording uses {other}-level verbs like: {eight}.\n\n"
    "IMPORTANT: Do NOT use verbs like {avoided}. Instead, use verbs like: {six}.\n\n{hints}\n\n"
    "Respond in this EXACT format (nothing else):\nQUESTION: [your question]\nANSWER: [a reference answer]"
)

# Patterns of named methods (the first is matched in any case, as are the others), of capitalised terms, of what a page's text leaves out, and of marked answers.
METHOD_PATTERNS = [
    r"([A-Z][a-z]+(?:'s)?\s+(?:law|principle|theory|theorem|equation|rule|effect|model|hypothesis|method|paradox|constant))",
    r"(?:the\s+)?(?:law|principle|theory|theorem)\s+of\s+([\w\s]+?)(?:\.|,|\s+is|\s+states)",
    r"(?:the\s+)?([\w\s]+?)\s+(?:formula|equation|method|technique|algorithm|procedure|process)",
]
#: What a text must hold for each of them to match.
METHOD_WORDS = [r"law|principle|theory|theorem|equation|rule|effect|model|hypothesis|method|paradox|constant", r"(?:law|principle|theory|theorem)\s+of", r"formula|equation|method|technique|algorithm|procedure|process"]
CAPITALISED = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
DROPPED_TAGS = ["figure", "table", "footer", "nav", "script", "style", "aside", "svg", "math"]
DROPPED_CLASSES = ["exercise", "problem", "solution", "review", "key-terms", "glossary", "os-teacher", "learning-objectives", "abstract"]
CAPTIONS = r"^(?:Figure|Table|Equation)\s+\d"
QUESTION_MARKER, ANSWER_MARKER = r"QUESTION:\s*(.+?)(?=ANSWER:|$)", r"ANSWER:\s*(.+)"
SHORT_QUESTION_MARKER, SHORT_ANSWER_MARKER = r"(?:^|\n)\s*Q:\s*(.+?)(?=\nA:|$)", r"(?:^|\n)\s*A:\s*(.+)"

# The words in which each rule states its evidence, and the first line that describes it. Results must equal them.
DETAILS = {
    "U1": {
        "empty": "Empty question", "mark": "Ends with '?'", "task": "Task prompt starting with '{found}'", "ending": "Response-request ending: '{found}'",
        "word": "Contains question word '{found}'", "none": "Ends with '{found}', not '?', and no task/question structure found",
    },
    "U2": {"short": "Too short: {n} words (min {least})", "long": "Too long: {n} words (max {most})", "ok": "{n} words (valid range)"},
    "U3": {
        "skipped": "No key concepts provided; skipped", "ok": "{n}/{total} key terms in Q+A: {found}",
        "none": "Only {n}/{total} key terms in Q+A (need >={least}). Found: {found}, missing: {missing}",
    },
    "U4": {"empty": "Empty output", "short": "Output too short: '{found}'", "repeated": "Word '{found}' repeated {n}x (max {most})", "ok": "No degenerate patterns detected"},
    "R1": {
        "verb": "Contains Remember verb: '{found}'", "pattern": "Contains recall pattern: '{found}'",
        "none": "No Remember verbs or recall patterns found. Expected Bloom's verbs {verbs}... or patterns like 'What is', 'How many', 'When did'...",
    },
    "R2": {
        "skipped": "No key concepts provided; skipped", "ok": "{n} concept(s) found: {found} (max {most})",
        "none": "{n} concepts found: {found} (max {most}). Remember questions should target a single concept.",
    },
    "R3": {"ok": "Answer is {n} words (max {most})", "none": "Answer is {n} words (max {most}). Remember answers should be short, factual."},
    "R4": {
        "skipped": "No content words in answer; skipped", "ok": "{share} of answer words found in passage (threshold {least})",
        "none": "Only {share} of answer words found in passage (need >={least}). Remember answers should be directly extractable.",
    },
    "D1": {
        "verb": "Contains Understand verb: '{found}'", "pattern": "Contains comprehension pattern: '{found}'",
        "none": "No Understand verbs or comprehension patterns found. Expected Bloom's verbs {verbs}... or patterns like 'Why is', 'How does', 'What is the purpose'...",
    },
    "D2": {
        "skipped": "Answer too short to evaluate; skipped", "ok": "{share} trigram overlap with passage (max {most}). Answer is paraphrased.",
        "none": "{share} trigram overlap with passage (max {most}). Understand answers should paraphrase, not copy.",
    },
    "D4": {"ok": "Contains meaning marker: '{found}'", "none": "No meaning markers found (how/why/explain/describe). Understand questions should ask about meaning."},
    "D3": {
        "skipped": "Missing passage or answer; skipped", "error": "NLI error: {found}", "ok": "Answer consistent with passage: contradiction={score} (threshold <0.5)",
        "none": "Answer contradicts passage: contradiction={score} (need <0.5). Understand answers must be consistent with the text.",
    },
    "P1": {
        "verb": "Contains Apply verb: '{found}'", "pattern": "Contains application pattern: '{found}'",
        "none": "No Apply verbs or application patterns found. Expected Bloom's verbs {verbs}... or patterns like 'If a...', 'Given that...', 'How would you...'...",
    },
    "P3": {
        "concept": "References passage concept: {found}", "method": "References method/principle: {found}", "shared": "Q+A shares {share} vocabulary with passage",
        "skipped": "No concepts/methods provided; skipped", "none": "Q+A does not reference passage concepts or methods.",
    },
    "P4": {"ok": "Answer contains specific result: '{found}'", "none": "Answer lacks specific result (no numbers, steps, or outcomes). Apply answers should contain concrete results."},
    "P2": {
        "skipped": "Missing passage or question; skipped", "error": "NLI error: {found}", "ok": "Question presents novel scenario: non-entailment={score} (threshold 0.55)",
        "none": "Scenario too similar to passage: non-entailment={score} (need >=0.55). Apply questions should present a new scenario.",
    },
    "A1": {
        "verb": "Contains Analyze verb: '{found}'", "pattern": "Contains analytical pattern: '{found}'",
        "none": "No Analyze verbs or analytical patterns found. Expected Bloom's verbs {verbs}... or patterns like 'How do X differ', 'What is the relationship'...",
    },
    "A2": {
        "skipped": "No key concepts provided; skipped", "ok": "{n} concepts found: {found} (min {least})",
        "none": "Only {n} concept(s) found: {found} (need >={least}). Analyze questions must connect multiple ideas.",
    },
    "A3": {"ok": "Contains relationship marker: '{found}'", "none": "No relationship markers found (between/differ/compare/affect). Analyze questions should ask about relationships."},
    "A4": {
        "skipped": "No key concepts provided; skipped", "unasked": "No passage concepts in question; skipped", "ok": "Answer covers all {n} concepts: {found}",
        "none": "Answer missing concepts: {missing}. Only covers {n}/{total}.",
    },
    "E1": {"verb": "Contains Evaluate verb: '{found}'", "none": "No Evaluate verbs found. Expected one of: {verbs}..."},
    "E2": {"ok": "Contains claim/judgment prompt: '{found}'", "none": "No claim/judgment markers found. Evaluate questions should present something to evaluate."},
    "E3": {"ok": "Contains evidence request: '{found}'", "none": "No evidence markers found (based on/evidence/justify). Evaluate questions should ask for evidence-based reasoning."},
    "E4": {"ok": "Answer contains contrastive marker: '{found}'", "none": "Answer lacks contrastive markers (however/although/but). Evaluate answers should contain argumentation."},
    "C1": {"verb": "Contains Create verb: '{found}'", "none": "No Create verbs found. Expected one of: {verbs}..."},
    "C3": {
        "ok": "{n} specification markers found: {found} (min {least})", "none": "Only {n} spec marker(s): {found} (need >={least}). Create questions should specify what to produce.",
    },
    "C4": {"ok": "Answer is {n} words (min {least})", "none": "Answer is only {n} words (need >{least}). Create answers should be substantial."},
    "C2": {
        "skipped": "Missing passage or answer; skipped", "error": "NLI error: {found}", "ok": "Answer is novel: non-entailment={score} (threshold 0.6)",
        "none": "Answer too similar to passage: non-entailment={score} (need >=0.6). Create answers should produce something new.",
    },
    "AV": {
        "skipped": "Not adversarial mode; skipped", "unknown": "No verbs defined for level {level}; skipped", "ok": "Uses vocabulary from L{level} ({name}): '{found}'",
        "none": "Does not use vocabulary from L{level} ({name}). Expected one of: {verbs}...",
    },
    "AN": {
        "skipped": "Not adversarial mode; skipped", "unknown": "No verbs defined for target level {level}; skipped", "ok": "Avoids target L{level} ({name}) vocabulary",
        "none": "Uses target vocabulary '{found}' from L{level} ({name}). Adversarial mode should use only the specified vocabulary level.",
    },
}
DESCRIPTIONS = {
    "U1": "U1: Output is a question or task prompt — ends with '?' or contains interrogative structure.", "U2": "U2: Question is 10-150 words.",
    "U3": "U3: Output is about the passage topic — >=2 key terms appear in question+answer combined.", "U4": "U4: No degenerate output — no word repeated >3 times, not empty.",
    "R1": "R1: Uses Remember-level vocabulary or natural recall framing.", "R2": "R2: Targets a single concept — at most 2 key concepts from passage appear.",
    "R3": "R3: Answer is short (factual) — <= 20 words.", "R4": "R4: Answer is findable in the passage — >=60% stemmed word overlap.",
    "D1": "D1: Uses Understand-level vocabulary or natural comprehension framing.", "D2": "D2: Answer is NOT copy-pasted from passage — <70% trigram overlap.",
    "D4": "D4: Asks about meaning, not bare facts — contains how/why/explain/describe.", "D3": "D3: Answer is consistent with the passage — NLI contradiction < 50%.",
    "P1": "P1: Uses Apply-level vocabulary or scenario-based application framing.", "P3": "P3: References a concept, method, or principle from the passage.",
    "P4": "P4: Answer contains a specific result — number, named outcome, or step.", "P2": "P2: Question describes a NEW scenario not in the passage — NLI non-entailment >55%.",
    "A1": "A1: Uses Analyze-level vocabulary or natural analytical framing.", "A2": "A2: References >=2 concepts from the passage.",
    "A3": "A3: Asks about relationships between concepts.", "A4": "A4: Answer addresses all referenced concepts from the question.",
    "E1": "E1: Uses Evaluate-level vocabulary.", "E2": "E2: Presents something to evaluate — a claim, position, or judgment prompt.",
    "E3": "E3: Asks for evidence-based reasoning.", "E4": "E4: Answer contains argumentation — has contrastive markers.",
    "C1": "C1: Uses Create-level vocabulary.", "C3": "C3: Specifies requirements — >=2 specification markers.",
    "C4": "C4: Answer is substantial and open-ended — >50 words.", "C2": "C2: Asks for something NOT in the passage — NLI non-entailment >60%.",
    "AV": "AV: In adversarial mode, uses vocabulary from the WRONG level (as specified).", "AN": "AN: In adversarial mode, should NOT use vocabulary from the TARGET level.",
}
