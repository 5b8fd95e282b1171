"""The fixed values as the SQL side states them: written out once more, so that a wrong value of the library shows as a difference."""

# Fixed values, in their published order.
LEVELS = {
    1: 'Remember',
    2: 'Understand',
    3: 'Apply',
    4: 'Analyze',
    5: 'Evaluate',
    6: 'Create',
}
DEFINITIONS = {
    1: 'recall facts and basic concepts from the passage',
    2: 'explain ideas or concepts in their own words',
    3: 'use information in new situations or solve problems',
    4: 'draw connections among ideas, compare and contrast',
    5: 'justify a stand or decision, critique or evaluate claims',
    6: 'produce new or original work, design or propose something',
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
PAIRINGS = {
    2: 1,
    3: 2,
    4: 1,
    5: 2,
    6: 3,
    1: 4,
}
TASK_STARTERS = [
    "evaluate", "assess", "critique", "judge", "argue", "defend", "design", "develop", "propose", "construct", "formulate", "create", "devise", "plan", "compose",
    "synthesize",
]
RESPONSE_ENDINGS = [
    "your argument", "your position", "your response", "your reasoning", "your answer", "your analysis", "your view", "your opinion", "your stance", "the passage",
    "from the passage", "based on the passage", "with evidence", "with examples",
]
QUESTION_WORDS = ["how", "why", "what", "which", "when", "where", "who", "can", "could", "would", "should", "does", "do", "is"]
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "of", "in", "to", "and", "or", "for", "on", "at", "by", "with", "that", "this", "it", "from", "as", "be", "has", "have",
    "had", "not", "but", "what", "how", "do", "does", "did", "can", "if", "which", "their", "its", "they", "you", "your",
]
ANSWER_STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "of", "in", "to", "and", "or", "for", "on", "at", "by", "with", "it"]
CONCEPT_STOP_WORDS = [
    "this", "that", "with", "from", "have", "been", "were", "they", "their", "which", "would", "could", "about", "there", "these", "other", "also", "more", "than", "into",
    "some", "when", "only", "each", "such", "most", "very", "much", "many", "just", "over", "between", "through", "same", "after", "before",
]
RECALL = [
    "what is", "what are", "what was", "what were", "what does", "what do", "what did", "what type", "what kind", "what form", "what part", "what vitamin", "what molecule",
    "what organ", "what structure", "what process", "what function", "what role", "what term", "what class", "what group", "what phylum", "what percentage", "what number",
    "what year", "what region", "what stage", "how many", "how much", "how long", "how old", "when did", "when does", "when was", "when is", "when were", "where is",
    "where are", "where does", "where do", "where did", "who is", "who was", "who are", "who did", "who discovered", "which is", "which are", "which was", "which of",
    "which type",
]
COMPREHENSION = [
    "why is", "why are", "why does", "why do", "why did", "why was", "why were", "why would", "why can", "why might", "how does", "how do", "how is", "how are", "how did",
    "how was", "how can", "how would", "how might", "what is the difference", "what is the purpose", "what is the role", "what is the function", "what is the significance",
    "what is the meaning", "what is the relationship", "what is the importance", "what happens when", "what happens if", "what would happen", "what is the effect",
    "what is the impact", "what is the result", "in what way", "in your own words", "what does it mean", "what do you understand", "given that", "considering that",
]
MEANING = ["how", "why", "explain", "describe", "what does", "what do", "in your own words", "in what way", "meaning of"]
APPLICATION = [
    "if a ", "if an ", "if the ", "if you ", "if we ", "given that", "given a ", "given an ", "given the ", "suppose ", "assuming ", "consider a ", "consider the ",
    "imagine ", "say that ", "how would you", "how could you", "how can you", "what would happen if", "what would be the result", "what steps", "what procedure",
    "what method", "a researcher", "a student", "a scientist", "an engineer", "a patient", "a doctor", "find the", "predict the", "estimate the", "what is the value",
    "what would the",
]
RESULTS = [
    r"\d+", r"step\s*\d", "first|second|third|finally", "result|outcome|solution|output", "therefore|thus|hence|consequently", "equals?|yields?|produces?|gives?",
    "because|since|due to|as a result", r"would\s+(be|cause|lead|result|produce|increase|decrease)", r"this\s+(means|indicates|suggests|shows|leads|causes|results)",
    r"the\s+(answer|solution|result|value|effect|consequence)\s+is", r"in\s+this\s+(case|scenario|situation)", r"by\s+(using|applying|following|performing)",
]
ANALYSIS = [
    "how do", "how does", "how is", "how are", "what is the relationship", "what is the connection", "what is the difference", "what are the differences",
    "what is the similarity", "what are the similarities", "in what way", "in what ways", "what role does", "what role do", "how do they differ", "how does it differ",
    "differ from", "different from", "differs from", "similar to", "compared to", "in comparison", "what factors", "what causes", "what contributes", "why does", "why do",
    "why is", "why are", "the relationship between", "the connection between", "the difference between", "the similarities between",
]
ACRONYMS = {
    'rer': 'rough endoplasmic reticulum',
    'ser': 'smooth endoplasmic reticulum',
    'er': 'endoplasmic reticulum',
    'dna': 'deoxyribonucleic acid',
    'rna': 'ribonucleic acid',
    'mrna': 'messenger rna',
    'trna': 'transfer rna',
    'atp': 'adenosine triphosphate',
    'adp': 'adenosine diphosphate',
    'nadh': 'nicotinamide adenine dinucleotide',
    'gdp': 'gross domestic product',
    'cns': 'central nervous system',
    'pns': 'peripheral nervous system',
}
RELATIONSHIP = [
    "between", "differ", "relate", "compare", "versus", "whereas", "how does", "affect", "influence", "impact", "connection", "relationship", "similarity", "difference",
    "in contrast", "as opposed to", "while", "on the other hand",
]
CLAIM = [
    "do you agree", "to what extent", "is it justified", "is it true", "is it valid", "would you recommend", "is it appropriate", "argue for or against",
    "defend or refute", "is it reasonable", "critique", "evaluate the claim", "evaluate this claim", "assess whether", "some argue", "the claim", "it has been claimed",
    "one could argue", "is it fair to say", "claims that", "it is claimed", "the argument", "should ", "should be", "should not", "could be considered",
    "can be considered", "would it be", "is it possible that", "is it accurate", "is it correct", "is it fair", "justify your", "justify this", "provide reasons",
    "give reasons", "support your", "provide evidence", "provide your reasoning", "strengths and weaknesses", "strengths and limitations", "advantages and disadvantages",
    "pros and cons", "how effective", "how appropriate", "how adequate", "how justified", "how significant", "how valid", "how important", "how well does",
    "how successful", "is there sufficient", "is there enough evidence", "what are the limitations", "what are the drawbacks", "what are the implications",
    "what are the consequences", "evaluate whether", "evaluate how", "evaluate the", "critically assess", "critically evaluate", "critically analyze", "weigh the",
    "judge the", "merit of", "your position", "your stance", "your opinion", "your argument", "your view", "take a position", "take a stance",
]
EVIDENCE = ["based on", "evidence", "criteria", "justify", "support", "why or why not", "provide reasons", "give evidence", "what evidence", "using examples", "with reference to"]
ARGUMENT = [
    "however", "although", "on the other hand", "nevertheless", "conversely", "in contrast", "despite", "whereas", "notwithstanding", "on the contrary", "nonetheless",
    "but ", "yet ", "while ", "therefore", "thus", "hence", "consequently", "because", "since ", "as a result", "this suggests", "this indicates", "this shows",
    "the evidence", "the data", "more effective", "less effective", "better", "worse", "stronger", "weaker", "superior", "inferior", "significant", "insufficient",
    "adequate", "inadequate", "valid", "invalid", "justified", "unjustified", "on one hand", "first,", "second,", "finally,", "in conclusion", "overall", "in summary",
    "the strength", "the weakness", "the limitation", "the advantage", "the disadvantage",
]
SPECS = ["must", "should", "include", "at least", "using", "ensure", "incorporate", "consider", "address", "that includes", "consisting of", "requirements", "criteria"]
SUFFIXES = ["ing", "tion", "sion", "ment", "ness", "ous", "ive", "able", "ible", "ful", "less", "ly", "ed", "er", "est", "es", "s"]
HINTS = {
    1: 'Your question must:\n- Ask for a single, specific fact from the passage\n- Have a short answer (under 20 words) that can be found directly in the text\n- Target only one concept',
    2: 'Your question must:\n- Ask for an explanation or interpretation, not just a bare fact\n- Use words like "how" or "why" or "explain"\n- The answer should paraphrase the passage, not copy it word-for-word\n- The answer must still be supported by the passage content',
    3: 'Your question must:\n- Present a NEW scenario or problem not described in the passage\n- Require using a method, formula, or principle FROM the passage to solve it\n- Have an answer with a specific result (a number, outcome, or concrete steps)',
    4: 'Your question must:\n- Reference at least 2 different concepts from the passage\n- Ask about the relationship between these concepts (compare, contrast, connect)\n- The answer must address all concepts mentioned in the question',
    5: 'Your question must:\n- Present a claim or position for the student to evaluate\n- Ask for evidence-based reasoning (use "justify", "based on", "why or why not")\n- The answer should contain argumentation with contrasting viewpoints',
    6: "Your question must:\n- Ask the student to design, create, or propose something original\n- Include at least 2 specific requirements or constraints\n- The answer should be substantial (more than 50 words) and go beyond what's in the passage",
}
METHOD_PATTERNS = [
    r"([A-Z][a-z]+(?:'s)?\s+(?:law|principle|theory|theorem|equation|rule|effect|model|hypothesis|method|paradox|constant))",
    r"(?:the\s+)?(?:law|principle|theory|theorem)\s+of\s+([\w\s]+?)(?:\.|,|\s+is|\s+states)",
    r"(?:the\s+)?([\w\s]+?)\s+(?:formula|equation|method|technique|algorithm|procedure|process)",
]
MODELS = [
    ('qwen2.5:14b', 'ollama', 'Qwen 2.5 14B', '14B'), ('llama3.1:8b', 'ollama', 'Llama 3.1 8B', '8B'), ('gemma3:12b', 'ollama', 'Gemma 3 12B', '12B'),
    ('phi4:14b', 'ollama', 'Phi-4 14B', '14B'), ('deepseek-r1:14b', 'ollama', 'DeepSeek-R1 14B', '14B'), ('mistral-nemo:12b', 'ollama', 'Mistral Nemo 12B', '12B'),
    ('gemma2:9b', 'ollama', 'Gemma 2 9B', '9B'), ('gpt-4o', 'openai', 'GPT-4o', '~200B'), ('claude-3-5-sonnet-20241022', 'anthropic', 'Claude 3.5 Sonnet', '~70B'),
    ('gemini-2.5-flash', 'google', 'Gemini 2.5 Flash', 'frontier'), ('deepseek-ai/DeepSeek-V3.1', 'together', 'DeepSeek-V3.1', '671B MoE'),
    ('meta-llama/Llama-3.3-70B-Instruct-Turbo', 'together', 'Llama 3.3 70B', '70B'),
]
#: id, name, tier, levels, description.
DESCRIBED = [
    ('U1', 'is_question', 'universal', [], "U1: Output is a question or task prompt — ends with '?' or contains interrogative structure."),
    ('U2', 'word_count', 'universal', [], 'U2: Question is 10-150 words.'),
    ('U3', 'passage_relevance', 'universal', [], 'U3: Output is about the passage topic — >=2 key terms appear in question+answer combined.'),
    ('U4', 'no_degenerate', 'universal', [], 'U4: No degenerate output — no word repeated >3 times, not empty.'),
    ('R1', 'remember_vocabulary', 'structural', [1], 'R1: Uses Remember-level vocabulary or natural recall framing.'),
    ('R2', 'single_concept', 'structural', [1], 'R2: Targets a single concept — at most 2 key concepts from passage appear.'),
    ('R3', 'short_answer', 'structural', [1], 'R3: Answer is short (factual) — <= 20 words.'),
    ('R4', 'answer_extractable', 'structural', [1], 'R4: Answer is findable in the passage — >=60% stemmed word overlap.'),
    ('D1', 'understand_vocabulary', 'structural', [2], 'D1: Uses Understand-level vocabulary or natural comprehension framing.'),
    ('D2', 'answer_not_copied', 'structural', [2], 'D2: Answer is NOT copy-pasted from passage — <70% trigram overlap.'),
    ('D4', 'asks_meaning', 'structural', [2], 'D4: Asks about meaning, not bare facts — contains how/why/explain/describe.'),
    ('D3', 'answer_supported', 'semantic', [2], 'D3: Answer is consistent with the passage — NLI contradiction < 50%.'),
    ('P1', 'apply_vocabulary', 'structural', [3], 'P1: Uses Apply-level vocabulary or scenario-based application framing.'),
    ('P3', 'method_reference', 'structural', [3], 'P3: References a concept, method, or principle from the passage.'),
    ('P4', 'specific_result', 'structural', [3], 'P4: Answer contains a specific result — number, named outcome, or step.'),
    ('P2', 'new_scenario', 'semantic', [3], 'P2: Question describes a NEW scenario not in the passage — NLI non-entailment >55%.'),
    ('A1', 'analyze_vocabulary', 'structural', [4], 'A1: Uses Analyze-level vocabulary or natural analytical framing.'),
    ('A2', 'multiple_concepts', 'structural', [4], 'A2: References >=2 concepts from the passage.'),
    ('A3', 'asks_relationship', 'structural', [4], 'A3: Asks about relationships between concepts.'),
    ('A4', 'answer_coverage', 'structural', [4], 'A4: Answer addresses all referenced concepts from the question.'),
    ('E1', 'evaluate_vocabulary', 'structural', [5], 'E1: Uses Evaluate-level vocabulary.'),
    ('E2', 'presents_claim', 'structural', [5], 'E2: Presents something to evaluate — a claim, position, or judgment prompt.'),
    ('E3', 'evidence_request', 'structural', [5], 'E3: Asks for evidence-based reasoning.'),
    ('E4', 'answer_argumentation', 'structural', [5], 'E4: Answer contains argumentation — has contrastive markers.'),
    ('C1', 'create_vocabulary', 'structural', [6], 'C1: Uses Create-level vocabulary.'),
    ('C3', 'specifications', 'structural', [6], 'C3: Specifies requirements — >=2 specification markers.'),
    ('C4', 'substantial_answer', 'structural', [6], 'C4: Answer is substantial and open-ended — >50 words.'),
    ('C2', 'novel_creation', 'semantic', [6], 'C2: Asks for something NOT in the passage — NLI non-entailment >60%.'),
    ('AV', 'adversarial_vocabulary', 'adversarial', [], 'AV: In adversarial mode, uses vocabulary from the WRONG level (as specified).'),
    ('AN', 'no_target_vocabulary', 'adversarial', [], 'AN: In adversarial mode, should NOT use vocabulary from the TARGET level.'),
]
