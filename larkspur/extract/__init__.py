"""What source files, lockfiles and project files hold."""
