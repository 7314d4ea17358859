from regframe.plans.pipeline import main

main()
