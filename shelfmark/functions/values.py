"""Words, names and patterns that results depend on."""

#: Missing-value markers of delimited files.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: Words that never connect two nodes.
LINK_STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is",
    "was", "are", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "should", "could", "may", "might", "must", "can", "data", "analysis", "study", "research", "using", "based",
    "method", "methods", "approach", "approaches", "model", "models", "system", "systems", "tool", "tools", "use",
    "used", "uses", "application", "applications", "code", "software", "program", "programs", "package", "packages",
    "library", "libraries", "framework", "frameworks", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x",
    "vs", "etc", "eg", "ie",
)

#: A feature whose name contains one of these holds text, so stop words are dropped from it.
TEXT_FIELDS = ("Code Summary", "Summary", "Description", "Abstract", "Languages", "Tools/Packages", "Tooling", "Data Types", "FAIR Issues", "Biomedical Relevance")

#: Words left out of word frequencies.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is",
    "was", "are", "were", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would", "should",
    "could", "may", "might", "must", "can", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we",
    "they", "not", "no", "yes", "na", "n/a", "unknown", "various", "multiple", "general", "other",
)
CODE_STOPWORDS = STOPWORDS + (
    "repository", "specified", "available", "tools", "analysis", "processing", "using", "implements", "based",
    "frameworks", "framework", "appears",
)
CELL_STOPWORDS = STOPWORDS + (
    "variant", "gene", "polymorphism", "allele", "located", "genetic", "studies", "associated", "including", "role",
    "disease", "through", "single", "chromosome", "population", "populations",
)

#: Apostrophe-like characters that become a plain one.
APOSTROPHES = "‘’‛ʼ´`"

DISEASE_KEYWORDS = ("alzheimer", "parkinson", "dementia", "brain", "neurodegenerative", "neurodegeneration", "tremor", "amyotrophic", "als", "cognitive impairment", "mild cognitive impairment", "mci", "lewy body")

#: Abbreviations that are common words or have other meanings.
NOISY_ABBREVIATIONS = (
    "leads", "prevent", "identity", "map", "ros", "codes", "mars", "campaign", "adams", "insight", "beam", "ample",
    "expedition", "caps", "elsa", "haas", "rosiglitazone", "gs", "lbp", "smi", "nph", "adcp", "hbs", "lcc", "twas",
    "a4", "adcs", "accord", "impact", "sprint", "promise", "compass", "focus", "vital", "spark", "echo", "grace",
    "hope", "care", "gait", "engage", "epic", "gain", "idea", "mind", "plan", "race", "safe", "team", "view", "act",
    "age", "aim", "cell", "core", "cure", "fast", "gene", "seed", "target", "track", "trend", "match", "predict",
    "select", "prime", "origin", "snap",
)

MODALITY_VOCABULARY = {
    "Clinical": "clinical", "Genetics": "genetics", "Genomics": "genetics", "genomics": "genetics", "genetic": "genetics",
    "Transcriptomics": "transcriptomics", "transcriptomic": "transcriptomics", "trasncriptomics": "transcriptomics",
    "Proteomics": "proteomics", "proteomcis": "proteomics", "Metabolomics": "metabolomics", "Epigenomics": "epigenomics",
    "epigenetics": "epigenomics", "Imaging": "imaging", "Other": "other", "cognitive": "skip", "immunological": "skip", "omics": "skip",
}

TOOLING_GROUPS = {
    "Python": ["Python", "python"], "R": ["R", "r"], "MATLAB": ["MATLAB", "Matlab", "matlab"], "C++": ["C++", "c++", "cpp"],
    "Java": ["Java", "java"], "JavaScript": ["JavaScript", "javascript", "JS", "js"], "Shell": ["Shell", "shell", "Bash", "bash"],
}
DATA_TYPE_GROUPS = {
    "Amyloid PET": ["Amyloid PET", "Amyloid-PET", "Amyloid_PET", "AmyloidPET"], "Tau PET": ["Tau PET", "Tau-PET", "Tau_PET", "TauPET"],
    "MRI": ["MRI", "Structural MRI", "sMRI", "T1-weighted MRI"], "fMRI": ["fMRI", "Functional MRI", "functional MRI", "resting-state fMRI", "rs-fMRI"],
    "DTI": ["DTI", "Diffusion Tensor Imaging", "diffusion MRI"], "Clinical": ["Clinical", "clinical assessments", "Clinical assessments"],
    "Cognitive": ["Cognitive", "cognitive testing", "Cognitive testing"], "Genetic": ["Genetic", "genetics", "Genomic", "genomics"],
    "Neuropathology": ["Neuropathology", "neuropathological"],
}
DISEASE_ALIASES = {
    "Alzheimer's Disease": ["Alzheimer's Disease", "Alzheimers Disease", "AD", "Alzheimer"], "Parkinson's Disease": ["Parkinson's Disease", "Parkinsons Disease", "PD", "Parkinson"],
    "Multiple Sclerosis": ["Multiple Sclerosis", "MS"], "ALS": ["ALS", "Amyotrophic Lateral Sclerosis"],
    "Lewy Body Dementia": ["Lewy Body Dementia", "LBD", "Dementia with Lewy Bodies", "DLB"],
}

#: Component -> (root-level file names that show it, issue when there is none, its details).
COMPLIANCE_FILES = {
    "has_readme": (("readme.md", "readme.rst", "readme.txt", "readme"), "No README", "Repository lacks a README file, reducing accessibility and understandability"),
    "has_dependencies": (("requirements.txt", "package.json", "setup.py", "cargo.toml", "go.mod", "pom.xml", "build.gradle"), "No Dependencies", "No dependency file found (requirements.txt, package.json, etc.), reducing reproducibility"),
    "has_version_info": ((".python-version", ".nvmrc", "runtime.txt", ".tool-versions"), "No Version Info", "No version specification file found, may cause compatibility issues"),
    "has_container": (("dockerfile", "docker-compose.yml", "docker-compose.yaml", ".dockerignore", "containerfile"), "No Container", "No Docker or container file found, limiting reproducibility across environments"),
    "has_environment": (("environment.yml", "environment.yaml", "conda.yml", "pipfile", "poetry.lock"), "No Environment Spec", "No environment specification file (conda, pipenv, etc.) found"),
}

#: Headers of an annotation's sections, in the order in which a line is tested for them.
SECTIONS = {"biomedical_relevance": "BIOMEDICAL RELEVANCE:", "summary": "CODE SUMMARY:", "data_types": "DATA TYPES:", "tools": "TOOLING:"}
