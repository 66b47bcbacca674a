"""End-to-end plans: building a course from files, and answering batches of questions."""
