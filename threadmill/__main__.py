from threadmill.cli import main

main()
