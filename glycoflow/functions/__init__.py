"""See README.md for what each module covers."""
