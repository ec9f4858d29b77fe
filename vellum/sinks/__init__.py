"""Where results go: word-processor files, audit and plan files."""
