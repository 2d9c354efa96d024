"""Extensions on Structured Streaming; not part of the parity surface."""
