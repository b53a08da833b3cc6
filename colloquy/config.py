"""Fixed values that must equal the reference's behaviour.

FIXED VALUES (defaults of the reference's loader, trainer and chat loop):
    loader max_seq_len            256
    training max_seq_len          448
    minimum tokens per example    2
    batch_size                    2
    accumulation_steps            6
    epochs                        2
    learning_rate                 3e-4
    min_lr                        1e-5
    warmup_steps                  500   (capped at total_steps // 10)
    warmup start factor           0.1
    log_interval                  100
    save_interval                 5000
    test_interval                 500
    pad token id (GPT-2 eos)      50256
    label ignore index            -100
    chat temperature              0.8
    chat max_new_tokens           200
    top_k                         50
    top_p                         0.9
    training-sampler top_k        50
    training-sampler max_tokens   50
    newline budget (stop rule)    3
    layer-norm epsilon            1e-5
    role prefixes                 "User: ", "Assistant: ", "System: "
    context block                 "\n\nContext: "
    prompt suffix                 "\nAssistant:"
    chat commands                 /quit /clear /temp /tokens
    end-of-text token             <|endoftext|>
    new pad token                 <|pad|>
    test prompts                  "User: Hello! How are you?\nAssistant:"
                                  "User: What is 2+2?\nAssistant:"
                                  "User: Tell me a fun fact.\nAssistant:"
"""

LOADER_MAX_SEQ_LEN = 256
TRAIN_MAX_SEQ_LEN = 448
MIN_TOKENS = 2
BATCH_SIZE = 2
ACCUMULATION_STEPS = 6
EPOCHS = 2
LEARNING_RATE = 3e-4
MIN_LR = 1e-5
WARMUP_STEPS = 500
WARMUP_START_FACTOR = 0.1
LOG_INTERVAL = 100
SAVE_INTERVAL = 5000
TEST_INTERVAL = 500
PAD_TOKEN_ID = 50256
IGNORE_INDEX = -100
TEMPERATURE = 0.8
MAX_NEW_TOKENS = 200
TOP_K = 50
TOP_P = 0.9
SAMPLER_TOP_K = 50
SAMPLER_MAX_TOKENS = 50
NEWLINE_BUDGET = 3
LAYER_NORM_EPS = 1e-5

USER_PREFIX = "User: "
ASSISTANT_PREFIX = "Assistant: "
SYSTEM_PREFIX = "System: "
CONTEXT_BLOCK = "\n\nContext: "
PROMPT_SUFFIX = "\nAssistant:"
EOS_TOKEN = "<|endoftext|>"
PAD_TOKEN = "<|pad|>"

TEST_PROMPTS = (
    "User: Hello! How are you?\nAssistant:",
    "User: What is 2+2?\nAssistant:",
    "User: Tell me a fun fact.\nAssistant:",
)

# Seed for every keyed permutation / draw (the reference is unseeded; ours is reproducible).
SEED = 42
