"""Keyword dictionaries.

The clinical lists below are fixed values: results only match when they are
used exactly as stated. Corpus dictionaries are parameters chosen from words
that occur in the test documents so every branch of the operators is hit.
"""

# Treatment keywords for the provisional binary label.
TREATMENT_KEYWORDS = [
    "procedure", "operation", "surgery", "theatre", "treatment", "intervention", "injection",
    "biopsy", "excision", "repair", "removal", "transplant", "admitted", "admission", "inpatient",
    "referred for", "referral to", "discharged", "consent obtained", "consent signed",
    "scheduled for", "booked for", "listed for", "clock stop", "rtt", "18 week",
    "commenced treatment", "started treatment", "prescribed", "initiated therapy",
]

# Routine keywords for the provisional binary label.
ROUTINE_KEYWORDS = [
    "routine follow-up", "follow up in", "review in", "stable", "no change", "unchanged",
    "monitoring", "surveillance", "watchful waiting", "continue current", "no new concerns",
    "appointment in", "clinic in", "doing well", "no intervention required",
    "conservative management", "reassured",
]

# Note topics for the keyword topic analysis (non-exclusive).
NOTE_TOPICS = {
    "Vaccination / Immunisation": ["vaccine", "vaccination", "immunis", "immuniz", "booster", "mmr", "flu shot"],
    "Well Child / Preventive": ["well child", "well-child", "routine exam", "preventive", "health maintenance"],
    "Acute Illness": ["fever", "infection", "acute", "presents with", "complains of", "sore throat", "cough"],
    "Chronic Disease Management": ["chronic", "diabetes", "hypertension", "asthma", "follow-up", "follow up",
                                   "management"],
    "Medication Review": ["medication", "prescription", "refill", "dosage", "drug", "pharmacy"],
    "Lab / Results": ["laboratory", "result", "blood test", "cbc", "hba1c", "creatinine", "lipid"],
    "Mental Health": ["anxiety", "depression", "mental health", "psychiatr", "counsel", "mood"],
    "Injury / Trauma": ["injury", "trauma", "fracture", "wound", "fall", "laceration"],
}

# Condition-name keywords per specialty; map order decides ties.
CONDITION_SPECIALTY_MAP = [
    ("cardiology", ["heart", "cardiac", "arrhythmia", "atrial", "valve", "failure", "angina", "myocardial",
                    "coronary", "pots", "lbbb", "bundle branch", "pericarditis", "brugada syndrome"]),
    ("gastroenterology", ["liver", "cirrhosis", "hepatitis", "bowel", "crohn", "colitis", "gastro", "coeliac",
                          "iron deficiency", "anaemia", "masld", "nafld", "ulcerative colitis"]),
    ("dermatology", ["skin", "dermat", "melanoma", "acne", "psoriasis", "eczema", "keratosis", "carcinoma",
                     "mole"]),
    ("orthopaedics", ["joint", "knee", "hip", "shoulder", "fracture", "arthritis", "carpal", "tendon",
                      "ligament", "bone", "spondylolisthesis"]),
    ("ophthalmology", ["eye", "ocular", "retina", "glaucoma", "cataract", "macular", "visual", "diabetic eye"]),
    ("urology", ["kidney", "bladder", "prostate", "urolog", "renal", "urinary", "incontinence"]),
    ("gynaecology", ["gynaecolog", "uterine", "ovarian", "pelvic", "endometriosis", "prolapse"]),
    ("ent", ["ear", "nose", "throat", "sinus", "tonsil", "hearing", "nasal", "septum"]),
    ("spinal", ["spine", "spinal", "lumbar", "disc", "scoliosis", "vertebra", "back pain", "sciatica"]),
    ("general_surgery", ["hernia", "gallbladder", "colorectal", "cholecystectomy", "haemorrhoid", "fistula",
                         "bowel resection"]),
    ("omfs", ["jaw", "dental", "oral", "maxillofacial", "mandibular", "temporomandibular", "tmj"]),
]

# Patient queries of a cohort run, assigned cyclically.
COHORT_QUERIES = [
    "Summarise this patient's medical history including conditions, medications and recent visits.",
    "What conditions does this patient have and what medications have been prescribed?",
    "What recent measurements and laboratory values are recorded for this patient?",
    "Provide a clinical summary of this patient's visit history and procedures.",
    "Based on this patient's conditions, which FastPIFU specialty skill is most relevant and what does it say "
    "about PIFU suitability?",
]

# Parameters for the test corpus (invented prose in four languages): frequent
# fragments per language, so flags and labels take every value.
CORPUS_TOPICS = {
    "english": [" the ", " and ", "tion"],
    "french": [" le ", " la ", "eau"],
    "german": [" die ", "sch", "ein"],
    "spanish": [" que ", " el ", "ción"],
    "digits": ["0", "1", "2"],
}
CORPUS_POSITIVE = ["the", "and", "ing", "tion"]
CORPUS_NEGATIVE = ["le", "la", "die", "que"]
# Parameters: condition-name routing for the test vocabulary (brand + type names).
CORPUS_SPECIALTY_MAP = [
    ("cardiology", ["standard"]),
    ("dermatology", ["promo", "brand#1 "]),
    ("orthopaedics", ["large", "economy"]),
    ("ent", ["small", "#2"]),
]
